"""String functions of the caption path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.numeric import let

# --- fixed values -------------------------------------------------------------
CATEGORY_CODES = {"0": "general", "1": "artist", "3": "copyright", "4": "character", "5": "meta", "9": "rating"}
CATEGORIES = ("general", "character", "copyright", "artist", "meta", "rating", "year", "model", "quality")
# order in which categories are offered for exclusion
CHOOSABLE_CATEGORIES = ("general", "character", "copyright", "artist", "meta", "model", "quality", "year")
# order in which grouped confidences are listed
CATEGORY_PRIORITY = ("general", "character", "copyright", "artist", "meta", "quality", "model", "year", "unknown")
CATEGORY_LABELS = {
    "general": "一般",
    "character": "角色",
    "copyright": "版权",
    "artist": "画师",
    "meta": "元数据",
    "model": "模型",
    "quality": "质量",
    "year": "年份",
    "unknown": "未分类",
}
MEDIA_TYPES = {"png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp"}
# white space as Unicode has it, for splitting and trimming
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKENS_PER_WORD = 1.3
WEIGHT_TOKENS = 6
# ------------------------------------------------------------------------------

def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def no_tags() -> Column:
    return F.array().cast("array<string>")


def normalize_category(raw: Column) -> Column:
    """Codes, lower-case and capitalised names to one lower-case set; else ``unknown``."""
    known = F.create_map(*[F.lit(v) for kv in {**CATEGORY_CODES, **{c: c for c in CATEGORIES}}.items() for v in kv])
    key = F.lower(F.trim(raw.cast("string")))
    return F.coalesce(F.try_element_at(known, key), F.lit("unknown"))


def category_rank(category: Column) -> Column:
    """Position in the listing order; names outside it come first, as index -1."""
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORY_PRIORITY]), category) - 1


def category_label(category: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in CATEGORY_LABELS.items() for v in kv])
    return F.coalesce(F.try_element_at(known, category), category)


def parse_tag_list(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), trimmed)
    return F.filter(parts, lambda t: t != "")


def spaced(tag: Column) -> Column:
    return F.replace(tag, F.lit("_"), F.lit(" "))


def clean_tag(tag: Column, replace_underscore: Column, excludes: Column) -> Column:
    return F.when(replace_underscore & ~F.array_contains(excludes, tag), spaced(tag)).otherwise(tag)


def escape_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, r"([\\()])", r"\\$1")


def token_estimate(tag: Column, weighted: Column) -> Column:
    words = F.size(F.filter(F.split(spaced(tag), f"{WHITE}+"), lambda w: w != ""))
    return (words * F.lit(TOKENS_PER_WORD)).cast("int") + 1 + F.when(weighted, F.lit(WEIGHT_TOKENS)).otherwise(F.lit(0))


def mapped_weight(conf: Column, threshold: Column, exponent: Column, low: Column, high: Column) -> Column:
    share = (conf - threshold) / (F.lit(1.0) - threshold + F.lit(1e-5))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    curved = F.when(exponent != 1.0, F.pow(share, exponent)).otherwise(share)
    return low + curved * (high - low)


def _product_error(a: Column, b: Column, product: Column) -> Column:
    """Exactly what rounding took from ``product = a * b`` (Dekker 1971)."""

    def halves(x: Column) -> tuple[Column, Column]:
        big = x * F.lit(134217729.0)
        high = big - (big - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    return ((ah * bh - product) + ah * bl + al * bh) + al * bl


def rounded_binary(value: Column, digits: Column) -> Column:
    """Non-negative ``value`` at ``digits`` decimals, decided by its exact binary value; ties to even."""
    scale = F.pow(F.lit(10.0), digits)

    def decide(z: Column) -> Column:
        p = z["v"] * z["s"]
        low = F.floor(p)
        past = (p - low) - F.lit(0.5)  # exact: both lie within one unit
        error = _product_error(z["v"], z["s"], p)
        up = (past > 0) | ((past == 0) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
        down = (past == 0) & (error < 0)
        return F.when(up & ~down, low + 1).otherwise(low) / z["s"]

    return let(F.struct(value.cast("double").alias("v"), scale.alias("s")), decide)


def weighted_text(tag: Column, weight: Column, weighted: Column, precision: Column) -> Column:
    """``(tag:1.05)``, rounded as the binary value rounds."""
    rounded = rounded_binary(weight, precision)
    number = F.call_function("format_string", F.concat(F.lit("%."), precision.cast("string"), F.lit("f")), rounded)
    shown = F.concat(F.lit("("), tag, F.lit(":"), number, F.lit(")"))
    return F.when(weighted & (F.abs(weight - 1.0) > 0.001), shown).otherwise(tag)


def display_name(uri: Column) -> Column:
    """File name, or ``[ZIP] archive/inner`` for archive entries."""
    inside = F.substring(uri, 7, 1 << 30)
    archive = F.substring_index(F.substring_index(inside, "::", 1), "/", -1)
    inner = F.regexp_replace(inside, r"^.*?::", "")
    return F.when(uri.startswith("zip://"), F.concat(F.lit("[ZIP] "), archive, F.lit("/"), inner)).otherwise(
        F.substring_index(uri, "/", -1)
    )


def base_name(uri: Column) -> Column:
    return F.substring_index(F.substring_index(uri, "::", -1), "/", -1)


def stem(uri: Column) -> Column:
    """Path without the last extension; dotted directories and dot-files keep their dots."""
    return F.regexp_replace(uri, r"(?<=[^/])\.[^./]*$", "")


def extension(uri: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(uri), r"(?<=.)\.([^.]*)$", 1))


def media_type(uri: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in MEDIA_TYPES.items() for v in kv])
    return F.coalesce(F.try_element_at(known, extension(uri)), F.lit("image/jpeg"))


def thumbnail_key(uri: Column, mtime_seconds: Column, side: int = 384, quality: int = 78) -> Column:
    """Cache name from path, whole-second mtime (0 inside archives), size and quality."""
    seconds = F.when(uri.startswith("zip://"), F.lit(0)).otherwise(F.coalesce(mtime_seconds, F.lit(0))).cast("bigint")
    return F.concat(F.md5(F.concat_ws("|", uri, seconds.cast("string"), F.lit(side).cast("string"), F.lit(quality).cast("string")).cast("binary")), F.lit(".jpg"))


def file_name(template: str, uri: Column, content: Column | None, output_ext: str) -> Column:
    """``[name]``, ``[extension]``, ``[hash:algo]``, ``[output_extension]``; other tokens stay."""
    base = base_name(uri)
    hashes = {"sha1": F.sha1, "md5": F.md5, **{f"sha{n}": (lambda c, n=n: F.sha2(c, n)) for n in (224, 256, 384, 512)}}

    def token(text: str) -> Column:
        name, *args = text[1:-1].split(":")
        if name == "name":
            return stem(base)
        if name == "extension":
            return F.regexp_extract(base, r"(?<=.)\.([^.]*)$", 1)
        if name == "output_extension":
            return F.lit(output_ext)
        if name == "hash" and content is not None and len(args) <= 1 and (args or ["sha1"])[0] in hashes:
            return F.coalesce(hashes[(args or ["sha1"])[0]](content), F.lit(text))
        return F.lit(text)

    pieces = re.split(r"(\[[\w:]+\])", template)
    return F.concat(*[token(p) if re.fullmatch(r"\[[\w:]+\]", p) else F.lit(p) for p in pieces if p])
