"""Queries about scores, tags and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import CAPTIONS, IMAGES, SCORES, captions, images, logits, table, tag_dict
from lumenloom.functions import tags as T
from lumenloom.operators import captions as C
from lumenloom.params import CaptionOptions


def scored(spark, sf):
    return C.score_items(logits(spark, sf), tag_dict(spark, sf), "camie", decimals=6)


def q_score_routing(spark, sf):
    return C.long_scores(scored(spark, sf)).select("image_id", "tag_idx", "name", "category", "conf", "route")


S_ROUTING = f"WITH {SCORES} SELECT image_id, tag_idx, name, category, conf, route FROM scores"


def _family(family):
    def q(spark, sf):
        p = logits(spark, sf).select("image_id", F.transform("logits", lambda x: F.round(C.sigmoid(x), 6)).alias("logits"))
        long = C.long_scores(C.score_items(p, tag_dict(spark, sf), family))
        return long.groupBy("route", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("conf"), 3).alias("total"))

    return q


def _family_sql(meta):
    return f"""WITH {SCORES}, r AS (SELECT *, CASE WHEN category='rating' OR name LIKE 'rating:%' THEN 'rating' WHEN category IN {meta} THEN 'meta' ELSE 'tags' END AS rt FROM allscores)
SELECT rt AS route, category, count(*) AS n, round(sum(conf),3) AS total FROM r GROUP BY 1,2"""


PLAIN = CaptionOptions()
RICH = CaptionOptions(
    threshold=0.2,
    additional_tags="masterpiece, best_quality",
    exclude_tags="tag_3, tag 5, tag_14_(x)",
    excluded_categories="artist, Year",
    replace_underscore_excludes="tag_10, o_o",
    escape_tag=True,
    core_tags="tag_1, blue_sky at noon",
    core_tags_weight=1.2,
    use_weight_mapping=True,
    weight_mapping_exponent=1.5,
    weight_min=0.8,
    weight_max=1.3,
    max_tags=12,
    token_limit=90,
)
SORTED = CaptionOptions(threshold=0.5, token_limit=0, sort_alphabetical=True, replace_underscore=False)


# white space of the rule: ASCII controls and blanks, next line, and the Unicode space separators
WHITE_SQL = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _words(tag):
    return f"trunc(len(list_filter(string_split_regex(replace({tag},'_',' '),'[{WHITE_SQL}]+'), lambda w: w<>''))*1.3::DOUBLE)::BIGINT + 1"


def caption_sql(o: CaptionOptions) -> str:
    """The caption rules of one option set as DuckDB SQL over the score CTEs."""
    def split(s):
        return [t.strip() for t in s.split(",") if t.strip()]

    def arr(xs):
        return "[" + ",".join("'" + x + "'" for x in xs) + "]::VARCHAR[]"

    add, exc, core, keep = (split(x) for x in (o.additional_tags, o.exclude_tags, o.core_tags, o.replace_underscore_excludes))
    cats = [c.lower() for c in split(o.excluded_categories)]
    banned = exc + ([e.replace("_", " ") for e in exc] if o.replace_underscore else [])
    clean = lambda t: f"(CASE WHEN {o.replace_underscore} AND NOT list_contains({arr(keep)},{t}) THEN replace({t},'_',' ') ELSE {t} END)"
    fin = lambda t: f"regexp_replace({clean(t)}, '([\\\\()])', '\\\\\\1', 'g')" if o.escape_tag else clean(t)
    scaled = o.add_confident_as_weight or o.use_weight_mapping
    flat = abs(o.weight_max - o.weight_min) < 0.01 and abs(o.weight_max - 1) < 0.01
    w = "1.0::DOUBLE"
    if scaled and not flat:
        n = f"greatest(0.0::DOUBLE,least(1.0::DOUBLE,(conf-{o.threshold}::DOUBLE)/(1.0::DOUBLE-{o.threshold}::DOUBLE+1e-5)))"
        w = f"{o.weight_min}::DOUBLE+power({n},{o.weight_mapping_exponent}::DOUBLE)*({o.weight_max}::DOUBLE-{o.weight_min}::DOUBLE)"
    weighted = scaled and not flat
    forced = abs(o.core_tags_weight - 1) > 0.001 or scaled
    text = lambda t, wt, on: f"CASE WHEN {on} AND abs({wt}-1.0)>0.001 THEN '(' || {fin(t)} || ':' || printf('%.{o.tag_precision}f', ({wt})::DOUBLE) || ')' ELSE {fin(t)} END"
    tok = lambda t, on: f"({_words(t)} + {6 if on else 0})"
    core_w = f"{o.core_tags_weight}::DOUBLE"
    core_items = "list_transform({0}, lambda t: {{'used': {1}, 'n': 1::BIGINT, 'out': [{2}]}})".format(arr(core), tok("t", forced), text("t", core_w, forced))
    room = f"({o.token_limit} - coalesce(list_sum(list_transform({arr(add)}, lambda t: {tok('t', False)})),0))"
    full = f"({o.max_tags}>0 AND acc.n>={o.max_tags})"
    over = f"({o.token_limit}>0 AND acc.used+x.used>{room})"
    order = "list_sort(tags)" if o.sort_alphabetical else "tags"
    return f"""kept AS (SELECT image_id, list({{'used': {tok('name', weighted)}, 'n': 1::BIGINT, 'out': [{text('name', w, weighted)}]}} ORDER BY conf DESC, tag_idx) AS model FROM scores
  WHERE route='tags' AND conf>={o.threshold} AND NOT list_contains({arr(cats)},category) AND NOT list_contains({arr(banned)},name) AND NOT list_contains({arr(banned)},{clean('name')})
    AND NOT list_contains({arr(core)},name) AND NOT list_contains({arr(core)},{clean('name')}) GROUP BY 1),
folded AS (SELECT v.image_id, list_reduce(list_concat({core_items}, coalesce(k.model,[])), lambda acc, x: CASE WHEN {full} OR {over} THEN acc ELSE {{'used': acc.used+x.used, 'n': acc.n+1, 'out': list_concat(acc.out,x.out)}} END, {{'used':0::BIGINT,'n':0::BIGINT,'out':[]::VARCHAR[]}}).out AS sel
  FROM vectors v LEFT JOIN kept k USING (image_id)),
joined AS (SELECT image_id, list_concat(list_transform({arr(add)}, lambda t: {fin('t')}), sel) AS raw FROM folded),
uniq AS (SELECT image_id, list_filter(raw, lambda t, i: list_position(raw,t)=i) AS tags FROM joined),
captioned AS (SELECT image_id, array_to_string({order}, ', ') AS caption, len(tags) AS n_tags FROM uniq)"""


def _caption(o):
    def q(spark, sf):
        return C.with_captions(scored(spark, sf), o).select("image_id", "caption", F.col("n_tags").cast("bigint").alias("n_tags"))

    return q


def _caption_sql(o):
    return f"WITH {SCORES},{caption_sql(o)} SELECT image_id, caption, n_tags FROM captioned"


PRESETS = {0: CaptionOptions(name="p0"), 1: CaptionOptions(name="p1", threshold=0.5, max_tags=5, escape_tag=True), 2: CaptionOptions(name="p2", use_weight_mapping=True, token_limit=60)}


def q_preset_captions(spark, sf):
    """Presets as rows, settings missing from a preset filled with defaults."""
    d = CaptionOptions()
    k = F.col("k")
    keys = table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("k")).distinct()
    rows = keys.select(
        F.concat(F.lit("p"), k.cast("string")).alias("name"),
        *[
            F.coalesce(*[F.when(k == i, F.lit(getattr(p, f))) for i, p in PRESETS.items() if getattr(p, f) != getattr(d, f)], F.lit(getattr(d, f))).alias(f)
            for f in C.literal_options(d)
            if f != "name"
        ],
    )
    spread = C.under_presets(scored(spark, sf), rows)
    out = C.with_captions(spread, C.column_options("preset."))
    return out.select("image_id", F.col("preset.name").alias("preset"), "caption")


S_PRESETS = " UNION ALL ".join(
    f"SELECT * FROM (WITH {SCORES},{caption_sql(p)} SELECT image_id, '{p.name}' AS preset, caption FROM captioned)" for p in PRESETS.values()
)


def q_caption_merge(spark, sf):
    i = F.col("image_id")
    new = images(spark, sf).select(
        F.regexp_replace("uri", r"\.png$", "").alias("uri_stem"),
        F.concat(F.lit("new_"), i.cast("string")).alias("caption"),
        F.element_at(F.array(*[F.lit(m) for m in ("ignore", "append", "prepend", "overwrite")]), (i % 4 + 1).cast("int")).alias("mode"),
    )
    return C.merge_captions(new, captions(spark, sf), F.col("mode")).select("uri_stem", "mode", "merged", "skipped")


S_MERGE = f"""WITH {CAPTIONS}, n AS (SELECT replace(uri,'.png','') AS uri_stem, 'new_' || image_id AS caption, ['ignore','append','prepend','overwrite'][image_id%4+1] AS mode FROM images)
SELECT n.uri_stem, mode, CASE WHEN c.caption IS NULL OR mode='overwrite' THEN n.caption WHEN mode='ignore' THEN c.caption WHEN trim(c.caption)='' THEN n.caption
 WHEN mode='append' THEN trim(c.caption) || ', ' || n.caption ELSE n.caption || ', ' || trim(c.caption) END AS merged, (c.caption IS NOT NULL AND mode='ignore') AS skipped
FROM n LEFT JOIN captions c USING (uri_stem)"""


def q_uncaptioned(spark, sf):
    i = images(spark, sf).withColumn("uri_stem", T.stem(F.col("uri")))
    return C.without_caption(i, captions(spark, sf)).select("image_id", "uri_stem")


S_UNCAPTIONED = f"WITH {CAPTIONS} SELECT image_id, replace(uri,'.png','') AS uri_stem FROM images WHERE replace(uri,'.png','') NOT IN (SELECT uri_stem FROM captions WHERE caption<>'')"


def q_top_tags(spark, sf):
    return C.top_tags(scored(spark, sf), 50).withColumn("rank", F.col("rank").cast("bigint"))


S_TOP = f"""WITH {SCORES} SELECT image_id, rank, name, round(conf,4) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, tag_idx) AS rank FROM scores WHERE route='tags') WHERE rank<=50"""


def q_grouped(spark, sf):
    return C.grouped_confidences(scored(spark, sf)).select("image_id", "category", "category_rank", F.col("rank").cast("bigint").alias("rank"), "name", "conf")


S_GROUPED = f"""WITH {SCORES} SELECT image_id, category, (list_position(['general','character','copyright','artist','meta','quality','model','year','unknown'],category)-1)::BIGINT AS category_rank,
 row_number() OVER (PARTITION BY image_id, category ORDER BY conf DESC, tag_idx) AS rank, name, conf FROM scores WHERE route='tags'"""


RAW_CATEGORIES = ("0", " 1", "3", "4", "5", "9", "General", "ARTIST", "Quality ", "weird", "7", "year", "MODEL")


def part_dictionary(spark, sf):
    """A dictionary with one tag per part, its category spelled in many ways."""
    raw = F.element_at(F.array(*[F.lit(c) for c in RAW_CATEGORIES]), (F.col("p_size") * 7 % len(RAW_CATEGORIES) + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("tag_idx"), F.col("p_name").alias("name"), T.normalize_category(raw).alias("category"))


PART_DICT = """pd AS (SELECT p_partkey AS tag_idx, ['general','artist','copyright','character','meta','rating','general','artist','quality','unknown','unknown','year','model'][p_size*7%13+1] AS category FROM part)"""


def q_census(spark, sf):
    return C.category_census(part_dictionary(spark, sf))


def q_present(spark, sf):
    return C.present_categories(part_dictionary(spark, sf)).select(F.array_join("present", ",").alias("present"))


S_PRESENT = f"WITH {PART_DICT} SELECT array_to_string(list_sort(list(DISTINCT category)),',') AS present FROM pd WHERE category NOT IN ('rating','unknown')"


def q_category_names(spark, sf):
    raw = F.element_at(F.array(*[F.lit(c) for c in ("0", " 1", "3", "4", "5", "9", "General", "ARTIST", "Quality ", "weird", "7")]), (F.col("p_partkey") % 11 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), T.normalize_category(raw).alias("category"))


S_CATEGORY = """SELECT p_partkey AS image_id, ['general','artist','copyright','character','meta','rating','general','artist','quality','unknown','unknown'][p_partkey%11+1] AS category FROM part"""


def q_tag_strings(spark, sf):
    """List parsing, cleaning, escaping and token estimates over part types and whole documents."""
    t = table(spark, sf, "part").select(
        F.col("p_partkey").alias("image_id"), F.concat(F.col("p_type"), F.lit("\u3000 ,\u00a0,"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(a\\b)")).alias("text")
    )
    parsed = t.select("image_id", F.posexplode(T.parse_tag_list(F.col("text"))).alias("pos", "tag"))
    clean = T.clean_tag(F.col("tag"), F.lit(True), F.array(F.lit("o_o")))
    return parsed.select(
        "image_id",
        F.col("pos").cast("bigint").alias("pos"),
        T.escape_tag(clean).alias("tag"),
        T.token_estimate(F.col("tag"), F.col("pos") == 1).cast("bigint").alias("tokens"),
    )


S_STRINGS = f"""WITH t AS (SELECT p_partkey AS image_id, list_filter(list_transform(string_split(p_type || chr(12288) || ' ,' || chr(160) || ',' || replace(p_name,' ','_') || '(a\\b)', ','), lambda x: regexp_replace(x, '^[{WHITE_SQL}]+|[{WHITE_SQL}]+$', '', 'g')), lambda x: x<>'') AS ts FROM part),
u AS (SELECT image_id, unnest(range(0,len(ts))) AS pos, unnest(ts) AS tag FROM t)
SELECT image_id, pos::BIGINT AS pos, regexp_replace(replace(tag,'_',' '), '([\\\\()])', '\\\\\\1', 'g') AS tag, {_words('tag')} + CASE WHEN pos=1 THEN 6 ELSE 0 END AS tokens FROM u"""


def q_document_tokens(spark, sf):
    """Every third gap of a document is an ideographic or a no-break space."""
    text = F.replace(F.replace("text", F.lit("e "), F.lit("e\u3000")), F.lit("n "), F.lit("n\u00a0"))
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(text, F.lit(False)).cast("bigint").alias("tokens"))


S_DOC_TOKENS = f"""SELECT doc_id, {_words("replace(replace(text, 'e ', 'e' || chr(12288)), 'n ', 'n' || chr(160))")} AS tokens FROM documents"""


def q_file_names(spark, sf):
    i = images(spark, sf)
    return i.select(
        "image_id",
        T.file_name("[name]-[hash:md5].[output_extension]", F.col("uri"), F.col("uri").cast("binary"), "txt").alias("md5_name"),
        T.file_name("[hash]_[extension]_[other]", F.col("uri"), F.col("uri").cast("binary"), "txt").alias("sha_name"),
        T.media_type(F.col("uri")).alias("media"),
        T.thumbnail_key(F.col("uri"), F.col("width")).alias("thumb"),
        T.display_name(F.concat(F.lit("zip://data/a"), (F.col("image_id") % 7).cast("string"), F.lit(".zip::"), F.col("uri"))).alias("shown"),
    )


S_FILES = f"""WITH {IMAGES} SELECT image_id, image_id || '-' || md5(uri) || '.txt' AS md5_name, sha1(uri) || '_png_[other]' AS sha_name, 'image/png' AS media,
 md5(uri || '|' || width || '|384|78') || '.jpg' AS thumb, '[ZIP] a' || (image_id%7) || '.zip/' || uri AS shown FROM images"""

QUERIES = {
    "score_routing": (q_score_routing, S_ROUTING),
    "score_routing_wd": (_family("wd"), _family_sql("('meta','year')")),
    "score_routing_custom": (_family("custom"), _family_sql("('meta','year','quality','model')")),
    "caption_default": (_caption(PLAIN), _caption_sql(PLAIN)),
    "caption_weighted": (_caption(RICH), _caption_sql(RICH)),
    "caption_sorted": (_caption(SORTED), _caption_sql(SORTED)),
    "preset_captions": (q_preset_captions, S_PRESETS),
    "caption_merge": (q_caption_merge, S_MERGE),
    "uncaptioned": (q_uncaptioned, S_UNCAPTIONED),
    "top_tags": (q_top_tags, S_TOP),
    "grouped_confidences": (q_grouped, S_GROUPED),
    "category_census": (q_census, f"WITH {PART_DICT} SELECT category, count(*) AS n FROM pd GROUP BY 1"),
    "present_categories": (q_present, S_PRESENT),
    "category_names": (q_category_names, S_CATEGORY),
    "tag_strings": (q_tag_strings, S_STRINGS),
    "document_tokens": (q_document_tokens, S_DOC_TOKENS),
    "file_names": (q_file_names, S_FILES),
}
