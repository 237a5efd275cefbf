"""From model scores to captions.

Scores stay one row per image: the tag dictionary is a single value of arrays, and filtering, ranking and the token budget are array expressions, so
captioning adds no shuffle to the scan of the scores.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenloom.functions.numeric import let
from lumenloom.functions.tags import (
    category_rank,
    clean_tag,
    escape_tag,
    mapped_weight,
    parse_tag_list,
    spaced,
    token_estimate,
    trimmed,
    weighted_text,
)
from lumenloom.operators.ordered import ordinal
from lumenloom.params import CaptionOptions

# --- fixed values: what counts as a rating or as metadata, per model family ----
RATING_NAMES = ("general", "sensitive", "questionable", "explicit", "safe", "nsfw")
RATING_PREFIX = "rating:"
META_CATEGORIES = {
    "wd": ("meta", "year"),
    "custom": ("meta", "year", "quality", "model"),
    "camie": ("meta", "year"),
}
PREFILTER = 0.05
LOGIT_LIMIT = 80.0
DICTIONARY_ROWS = 1_000_000  # a dictionary beyond this is joined to the scores
# --------------------------------------------------------------------------------


def sigmoid(logit: Column) -> Column:
    x = F.greatest(F.lit(-LOGIT_LIMIT), F.least(F.lit(LOGIT_LIMIT), logit))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def dictionary_value(tag_dict: DataFrame) -> Column:
    """The dictionary (tag_idx, name, category) as one value of parallel arrays, its size checked.

    It enters the plan as a scalar subquery, so no join is needed.
    """
    ordered = F.array_sort(F.collect_list(F.struct("tag_idx", "name", "category")))
    arrays = F.struct(F.col("d.tag_idx").alias("idx"), F.col("d.name").alias("names"), F.col("d.category").alias("categories"))
    return tag_dict.agg(ordered.alias("d")).select(arrays.alias("dictionary")).scalar()


def route_of(family: str, name: Column, category: Column) -> Column:
    """rating, meta or tags, by the rules of the model family."""
    if family == "camie":
        rating = F.lower(category) == "rating"
    else:
        shown = F.lower(name) if family == "custom" else name
        rating = (category == "rating") | shown.isin(*RATING_NAMES) | shown.startswith(RATING_PREFIX)
    return F.when(rating, "rating").when(F.lower(category).isin(*META_CATEGORIES[family]), "meta").otherwise("tags")


def score_items(scores: DataFrame, tag_dict: DataFrame, family: str = "camie", decimals: int | None = None) -> DataFrame:
    """Adds ``items``: array of (tag_idx, name, category, conf, route) per image.

    The ``camie`` family gives logits: they pass a sigmoid and the prefilter
    before names are attached. Other families give probabilities, all kept.
    """
    def conf(x: Column) -> Column:
        p = sigmoid(x.cast("double")) if family == "camie" else x.cast("double")
        return p if decimals is None else F.round(p, decimals)

    def named(d: Column) -> Column:
        known = F.slice(F.col("logits"), F.lit(1), F.size(d["names"]))
        pairs = F.transform(known, lambda x, i: F.struct(i.alias("i"), conf(x).alias("p")))
        if family == "camie":
            pairs = F.filter(pairs, lambda s: s["p"] > PREFILTER)
        return F.transform(
            pairs,
            lambda s: F.struct(
                d["idx"][s["i"]].cast("int").alias("tag_idx"),
                d["names"][s["i"]].alias("name"),
                d["categories"][s["i"]].alias("category"),
                s["p"].alias("conf"),
                route_of(family, d["names"][s["i"]], d["categories"][s["i"]]).alias("route"),
            ),
        )

    if tag_dict.limit(DICTIONARY_ROWS + 1).count() > DICTIONARY_ROWS:
        return _joined_items(scores, tag_dict, family, conf)
    known = scores.withColumn("_dictionary", dictionary_value(tag_dict))
    return known.withColumn("items", let(F.col("_dictionary"), named)).drop("_dictionary")


def _joined_items(scores: DataFrame, tag_dict: DataFrame, family: str, conf) -> DataFrame:
    """The same items for a dictionary too large to be one value: scores and entries meet by position.

    Every image has an entry of each label, so the rows are salted by image.
    """
    salts = 64
    # a position is that of the entry in index order
    places = ordinal(tag_dict.select("tag_idx", "name", "category"), [F.col("tag_idx")], "_at")
    places = places.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = scores.select("image_id", F.pmod(F.xxhash64("image_id"), F.lit(salts)).cast("int").alias("_salt"), F.posexplode("logits").alias("_at", "x"))
    rows = rows.withColumn("p", conf(F.col("x"))).withColumn("_at", F.col("_at").cast("bigint"))
    if family == "camie":
        rows = rows.where(F.col("p") > PREFILTER)
    item = F.struct(F.col("tag_idx").cast("int").alias("tag_idx"), "name", "category", F.col("p").alias("conf"), route_of(family, F.col("name"), F.col("category")).alias("route"))
    met = rows.join(places, ["_at", "_salt"]).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("_at", item.alias("item")))).alias("i"))
    items = met.select("image_id", F.transform("i", lambda s: s["item"]).alias("items"))
    empty = F.array().cast(items.schema["items"].dataType)
    return scores.join(items, "image_id", "left").withColumn("items", F.coalesce("items", empty))


def long_scores(scored: DataFrame, key: str = "image_id") -> DataFrame:
    return scored.select(key, F.explode("items").alias("s")).select(key, "s.*")


def route_map(items: Column, route: str) -> Column:
    """{name: confidence} of one route; a repeated name keeps its last score."""
    chosen = F.filter(items, lambda s: s["route"] == route)
    return F.map_from_entries(F.transform(chosen, lambda s: F.struct(s["name"], s["conf"])))


def literal_options(o: CaptionOptions) -> dict[str, Column]:
    return {f.name: F.lit(getattr(o, f.name)) for f in fields(o)}


def column_options(prefix: str = "") -> dict[str, Column]:
    """Options read from columns, one preset per row."""
    return {f.name: F.col(prefix + f.name) for f in fields(CaptionOptions)}


def caption_tags(items: Column, o: dict[str, Column]) -> Column:
    """Ordered, formatted tags of one image under a token budget.

    Core tags come first with a forced weight, then model tags by falling
    confidence. A tag that would pass the budget is skipped, not a stop; the
    tag limit stops. Additional tags are put in front and pay tokens first.
    """
    lists = F.struct(
        parse_tag_list(o["additional_tags"]).alias("additional"),
        parse_tag_list(o["exclude_tags"]).alias("exclude"),
        parse_tag_list(o["core_tags"]).alias("core"),
        parse_tag_list(o["replace_underscore_excludes"]).alias("keep"),
        F.transform(parse_tag_list(o["excluded_categories"]), F.lower).alias("categories"),
    )
    under = o["replace_underscore"]
    scaled = o["add_confident_as_weight"] | o["use_weight_mapping"]
    flat = (F.abs(o["weight_max"] - o["weight_min"]) < 0.01) & (F.abs(o["weight_max"] - 1.0) < 0.01)

    def finished(tag: Column, p: Column) -> Column:
        cleaned = clean_tag(tag, under, p["keep"])
        return F.when(o["escape_tag"], escape_tag(cleaned)).otherwise(cleaned)

    def item(tag: Column, weight: Column, weighted: Column) -> Column:
        return F.struct(
            tag.alias("tag"), weight.cast("double").alias("weight"), weighted.alias("weighted"), token_estimate(tag, weighted).alias("tokens")
        )

    def candidates(p: Column) -> Column:
        banned = F.when(under, F.array_union(p["exclude"], F.transform(p["exclude"], spaced))).otherwise(p["exclude"])

        def wanted(s: Column) -> Column:
            tag = s["name"]
            shown = clean_tag(tag, under, p["keep"])

            def absent(arr: Column) -> Column:
                return ~F.array_contains(arr, shown) & ~F.array_contains(arr, tag)

            allowed = (F.size(p["categories"]) == 0) | ~F.array_contains(p["categories"], F.coalesce(s["category"], F.lit("unknown")))
            return (s["route"] == "tags") & (s["conf"] >= o["threshold"]) & allowed & absent(banned) & absent(p["core"])

        ranked = F.array_sort(
            F.transform(F.filter(items, wanted), lambda s: F.struct((-s["conf"]).alias("c"), s["tag_idx"].alias("i"), s["name"].alias("name")))
        )
        model = F.transform(
            ranked,
            lambda s: item(
                s["name"],
                F.when(scaled & ~flat, mapped_weight(-s["c"], o["threshold"], o["weight_mapping_exponent"], o["weight_min"], o["weight_max"])).otherwise(F.lit(1.0)),
                scaled & ~flat,
            ),
        )
        forced = (F.abs(o["core_tags_weight"] - 1.0) > 0.001) | scaled
        core = F.transform(p["core"], lambda t: item(t, o["core_tags_weight"], forced))
        return F.concat(core, model)

    def budgeted(p: Column) -> Column:
        spent = F.aggregate(p["additional"], F.lit(0), lambda acc, t: acc + token_estimate(t, F.lit(False)))
        room = o["token_limit"].cast("int") - spent
        start = F.struct(
            F.lit(0).alias("used"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<tag:string,weight:double,weighted:boolean>>)").alias("out")
        )

        def take(acc: Column, it: Column) -> Column:
            full = (o["max_tags"] > 0) & (acc["n"] >= o["max_tags"])
            over = (o["token_limit"] > 0) & (acc["used"] + it["tokens"] > room)
            grown = F.struct(
                (acc["used"] + it["tokens"]).alias("used"),
                (acc["n"] + 1).alias("n"),
                F.array_append(acc["out"], F.struct(it["tag"].alias("tag"), it["weight"].alias("weight"), it["weighted"].alias("weighted"))).alias("out"),
            )
            return F.when(full | over, acc).otherwise(grown)

        chosen = F.aggregate(candidates(p), start, take)["out"]
        front = F.transform(p["additional"], lambda t: finished(t, p))
        rest = F.transform(chosen, lambda s: weighted_text(finished(s["tag"], p), s["weight"], s["weighted"], o["tag_precision"]))
        tags = F.array_distinct(F.concat(front, rest))
        return F.when(o["sort_alphabetical"], F.array_sort(tags)).otherwise(tags)

    return let(lists, budgeted)


def with_captions(scored: DataFrame, options: CaptionOptions | dict[str, Column]) -> DataFrame:
    """Adds ``caption`` and ``n_tags`` to rows with ``items``."""
    o = literal_options(options) if isinstance(options, CaptionOptions) else options
    tagged = scored.withColumn("_tags", caption_tags(F.col("items"), o))
    return tagged.withColumns({"caption": F.array_join("_tags", ", "), "n_tags": F.size("_tags")}).drop("_tags")


def under_presets(scored: DataFrame, presets: DataFrame, few: int = 1000) -> DataFrame:
    """Every image under every preset, which is what is asked for.

    Presets counted to be few ride along as one array; more are joined in
    blocks of that many, so no single value grows with their number.
    """
    if presets.limit(few + 1).count() <= few:
        packed = presets.agg(F.collect_list(F.struct(*presets.columns)).alias("p")).scalar()
        return scored.withColumn("_presets", packed).withColumn("preset", F.explode("_presets")).drop("_presets")
    blocks = F.ceil(presets.count() / F.lit(few))
    dealt = presets.select(F.pmod(F.xxhash64(*presets.columns), blocks).alias("_block"), F.struct(*presets.columns).alias("preset"))
    packed = dealt.groupBy("_block").agg(F.collect_list("preset").alias("_presets"))
    numbered = scored.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(presets.count() // few).cast("bigint"))))
    return numbered.join(packed, "_block").withColumn("preset", F.explode("_presets")).drop("_presets", "_block")


def merge_captions(new: DataFrame, existing: DataFrame, mode: Column | str, key: str = "uri_stem") -> DataFrame:
    """Resolve a new caption against one already there.

    ``ignore`` keeps the old text and counts as skipped; append and prepend join
    with the trimmed old text unless that is empty.
    """
    how = F.lit(mode) if isinstance(mode, str) else mode
    joined = new.join(existing.select(key, F.col("caption").alias("_old")), key, "left")
    old = trimmed(F.col("_old"))
    fresh = F.col("caption")
    merged = (
        F.when(F.col("_old").isNull() | (how == "overwrite"), fresh)
        .when(how == "ignore", F.col("_old"))
        .when(old == "", fresh)
        .when(how == "append", F.concat(old, F.lit(", "), fresh))
        .when(how == "prepend", F.concat(fresh, F.lit(", "), old))
        .otherwise(fresh)
    )
    return joined.withColumns({"merged": merged, "skipped": F.col("_old").isNotNull() & (how == "ignore")}).drop("_old")


def without_caption(images: DataFrame, captions: DataFrame, overwrite: bool = False, key: str = "uri_stem") -> DataFrame:
    """Images still to be captioned: no caption file, or an empty one."""
    if overwrite:
        return images
    return images.join(captions.where(F.length("caption") > 0).select(key), key, "left_anti")


def top_tags(scored: DataFrame, n: int = 50) -> DataFrame:
    """The n most confident plain tags per image, rounded to four places, best first."""
    ranked = F.array_sort(
        F.transform(F.filter("items", lambda s: s["route"] == "tags"), lambda s: F.struct((-s["conf"]).alias("c"), s["tag_idx"].alias("i"), s["name"].alias("name")))
    )
    return scored.select("image_id", F.posexplode(F.slice(ranked, 1, n)).alias("rank", "s")).select(
        "image_id", (F.col("rank") + 1).alias("rank"), F.col("s.name").alias("name"), (F.floor(-F.col("s.c") * 1e4 + F.lit(0.5)) / 1e4).alias("conf")
    )


def grouped_confidences(scored: DataFrame) -> DataFrame:
    """Tags by category, categories in listing order; groups are bounded by the dictionary."""
    flat = long_scores(scored).where("route = 'tags'")
    w = Window.partitionBy("image_id", "category").orderBy(F.col("conf").desc(), "tag_idx")
    return flat.withColumns({"category_rank": category_rank(F.col("category")), "rank": F.row_number().over(w)})


def category_census(tag_dict: DataFrame) -> DataFrame:
    return tag_dict.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def present_categories(tag_dict: DataFrame) -> DataFrame:
    """Sorted categories that can be excluded, as one array."""
    choosable = F.when(~F.col("category").isin("rating", "unknown"), F.col("category"))
    return tag_dict.agg(F.array_sort(F.collect_set(choosable)).alias("present"))
