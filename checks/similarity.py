"""Queries about hashes, similar pairs and duplicate groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import FINGERPRINTS, PLANES, VECTORS, fingerprints, planes, table, vectors
from lumenloom.functions import hashing as H
from lumenloom.functions.colour import display_value, linear_light
from lumenloom.functions.numeric import let
from lumenloom.operators.clustering import mark_all_but_largest
from lumenloom.operators.similarity import similar_classes, similar_pairs
from lumenloom.params import SIMILARITY_PRESETS, SimilarityOptions
from lumenloom.plans import dedup

BALANCED = SIMILARITY_PRESETS["balanced"]


def q_average_hash(spark, sf):
    v = vectors(spark, sf)
    return v.select("image_id", H.bit_string(H.average_bits(F.col("e"))).alias("bits"))


S_AHASH = f"""WITH {VECTORS}, z AS (SELECT *, list_reduce(e, lambda a,b: a+b, 0.0::DOUBLE)/64 AS m FROM vectors)
SELECT image_id, array_to_string(list_transform(e, lambda v: CASE WHEN v>m THEN '1' ELSE '0' END),'') AS bits FROM z"""


def q_difference_hash(spark, sf):
    return planes(spark, sf).select("image_id", H.bit_string(H.difference_bits(F.col("plane"), 8, 8)).alias("bits"))


S_DHASH = f"WITH {FINGERPRINTS} SELECT image_id, b2 AS bits FROM fp"


def q_median_hash(spark, sf):
    v = vectors(spark, sf)
    return v.select("image_id", H.bit_string(H.median_bits(F.col("e"))).alias("bits"))


S_MEDIAN = f"""WITH {VECTORS}, z AS (SELECT *, list_median(e) AS m FROM vectors)
SELECT image_id, array_to_string(list_transform(e, lambda v: CASE WHEN v>m THEN '1' ELSE '0' END),'') AS bits FROM z"""


def q_wavelet_hash(spark, sf):
    """Low band of a 16x16 plane, taken from the character counts."""
    p = planes(spark, sf)
    wide = let(
        F.col("plane"), lambda q: F.array(*[F.element_at(q, (r * 17 + c * 5) % 64 + 1) + F.lit(r * c) for r in range(16) for c in range(16)])
    )
    p = p.select("image_id", H.block_means(wide, 16).alias("low"))
    return p.select("image_id", H.bit_string(H.median_bits(F.col("low"))).alias("bits"))


S_WAVELET = f"""WITH {PLANES},
low AS (SELECT image_id, list_transform(range(0,64), lambda k: (
  plane[(((k//8)*2)*17+((k%8)*2)*5)%64+1] + ((k//8)*2)*((k%8)*2) + plane[(((k//8)*2)*17+((k%8)*2+1)*5)%64+1] + ((k//8)*2)*((k%8)*2+1) +
  plane[(((k//8)*2+1)*17+((k%8)*2)*5)%64+1] + ((k//8)*2+1)*((k%8)*2) + plane[(((k//8)*2+1)*17+((k%8)*2+1)*5)%64+1] + ((k//8)*2+1)*((k%8)*2+1))/4.0::DOUBLE) AS low FROM planes),
z AS (SELECT image_id, low, list_median(low) AS m FROM low)
SELECT image_id, array_to_string(list_transform(low, lambda v: CASE WHEN v>m THEN '1' ELSE '0' END),'') AS bits FROM z"""


def q_perceptual_hash(spark, sf):
    """DCT hash of a 32x32 plane built from the character counts."""
    p = planes(spark, sf)
    rows, cols = F.sequence(F.lit(0), F.lit(31)), F.sequence(F.lit(0), F.lit(31))

    def cell(q, r, c):
        return ((F.element_at(q, r + 1) * 3 + F.element_at(q, c + 33) * 5 + r * c) % 256).cast("int")

    px = let(F.col("plane"), lambda q: F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: cell(q, r, c)))))
    h = H.with_perceptual_hash(p.select("image_id", px.alias("px")), "px", "h")
    return h.select("image_id", F.lpad(F.bin("h"), 64, "0").alias("bits"))


S_PHASH = f"""WITH {PLANES},
px AS (SELECT image_id, r, c, ((plane[r+1]*3 + plane[33+c]*5 + r*c)::BIGINT % 256)::DOUBLE AS v FROM planes, range(0,32) a(r), range(0,32) b(c)),
basis AS (SELECT k, x, 2*cos(pi()*k*(2*x+1)/64.0) AS w FROM range(0,8) a(k), range(0,32) b(x)),
s1 AS (SELECT image_id, r, k AS v, sum(p.v*w) AS t FROM px p JOIN basis ON x=c GROUP BY 1,2,3),
s2 AS (SELECT image_id, k AS u, v, round(sum(t*w),6) AS f FROM s1 JOIN basis ON x=r GROUP BY 1,2,3),
m AS (SELECT *, median(f) OVER (PARTITION BY image_id) AS med FROM s2)
SELECT image_id, string_agg(CASE WHEN f>med THEN '1' ELSE '0' END, '' ORDER BY u, v) AS bits FROM m GROUP BY 1"""


def q_color_signature(spark, sf):
    k, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    px = table(spark, sf, "lineitem").select(
        k.alias("image_id"), ((o * 7 + n) % 256).alias("r"), ((o * 13 + k) % 256).alias("g"), ((o * 5 + n * 3) % 256).alias("b")
    )
    sig = H.color_signature(px, "image_id")
    return sig.select("image_id", F.posexplode("color").alias("bin", "v")).where("v > 0").select(
        "image_id", F.col("bin").cast("bigint").alias("bin"), F.round("v", 6).alias("v")
    )


S_COLOR = """WITH px AS (SELECT l_partkey AS image_id, (l_orderkey*7+l_linenumber)%256 AS r, (l_orderkey*13+l_partkey)%256 AS g, (l_orderkey*5+l_linenumber*3)%256 AS b FROM lineitem)
SELECT image_id, ((r//64)*4+(g//64))*4+(b//64) AS bin, round(count(*)/sum(count(*)) OVER (PARTITION BY image_id),6) AS v FROM px GROUP BY 1,2"""


def q_linear_light(spark, sf):
    """Bytes of made-up pixels as linear light and back."""
    byte = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 256
    px = table(spark, sf, "lineitem").select(byte.alias("byte"), linear_light(byte / 255).alias("light"))
    back = F.floor(display_value(F.col("light")) * 255 + 0.5).cast("bigint")
    return px.groupBy("byte").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("light"), 9).alias("light"), F.max(back).alias("back"))


S_LIGHT = """WITH px AS (SELECT (l_orderkey*7+l_linenumber)%256 AS byte FROM lineitem)
SELECT byte, count(*) AS n, round(CASE WHEN byte/255<=0.04045 THEN byte/255/12.92 ELSE power((byte/255+0.055)/1.055, 2.4) END, 9) AS light, byte::BIGINT AS back FROM px GROUP BY byte"""


def _pair_query(name):
    def q(spark, sf):
        pairs, _ = similar_classes(fingerprints(spark, sf), SIMILARITY_PRESETS[name])
        return pairs.select("src", "dst", F.col("d1").cast("bigint").alias("d1"))

    return q


def _pair_sql(o: SimilarityOptions) -> str:
    dual = f"AND bit_count(xor(a.b2::BIT,b.b2::BIT)) <= {o.secondary_threshold}" if o.require_dual_hash else ""
    color = f"AND list_sum(list_transform(list_zip(a.color,b.color), lambda z: abs(z[1]-z[2]))) <= {o.color_distance_max}" if o.color_distance_max is not None else ""
    return f"""WITH {FINGERPRINTS}
SELECT a.image_id AS src, b.image_id AS dst, bit_count(xor(a.b1::BIT,b.b1::BIT))::BIGINT AS d1 FROM fp a JOIN fp b ON a.image_id<b.image_id
WHERE abs(a.aspect-b.aspect)/greatest(a.aspect,b.aspect) <= {o.ar_tolerance} AND bit_count(xor(a.b1::BIT,b.b1::BIT)) <= {o.threshold} {dual} {color}"""


def _class_sql(o: SimilarityOptions) -> str:
    """The pairs of those images that are the first of their copies."""
    return f"""SELECT p.src, p.dst, p.d1 FROM ({_pair_sql(o)}) p
WHERE p.src IN (WITH {FINGERPRINTS} SELECT min(image_id) FROM fp GROUP BY b1, b2, color, aspect) AND p.dst IN (WITH {FINGERPRINTS} SELECT min(image_id) FROM fp GROUP BY b1, b2, color, aspect)"""


def q_pairs_expanded(spark, sf):
    """Every pair of images, copies too: they meet in the tiles as others do, so that no pair is shuffled."""
    return similar_pairs(fingerprints(spark, sf), BALANCED).select("src", "dst", F.col("d1").cast("bigint").alias("d1"))


def q_pairs_wide(spark, sf):
    """Wide threshold on vectors, where real pairs are rare and recall is hard."""
    v = vectors(spark, sf).select(
        "image_id",
        H.pack_bits(H.average_bits(F.col("e"))).alias("h1"),
        F.lit(None).cast("bigint").alias("h2"),
        F.lit(None).cast("array<double>").alias("color"),
        F.lit(1.0).alias("aspect"),
    )
    return similar_pairs(v, SimilarityOptions(20, 1.0, False, None)).select("src", "dst", F.col("d1").cast("bigint").alias("d1"))


S_WIDE = f"""WITH {VECTORS}, z AS (SELECT *, list_reduce(e, lambda a,b: a+b, 0.0::DOUBLE)/64 AS m FROM vectors),
b AS (SELECT image_id, array_to_string(list_transform(e, lambda v: CASE WHEN v>m THEN '1' ELSE '0' END),'')::BIT AS b1 FROM z)
SELECT a.image_id AS src, c.image_id AS dst, bit_count(xor(a.b1,c.b1))::BIGINT AS d1 FROM b a JOIN b c ON a.image_id<c.image_id WHERE bit_count(xor(a.b1,c.b1)) <= 20"""


def q_hash_distance(spark, sf):
    """Distances of every document to its first copy-class neighbour in source order."""
    f = fingerprints(spark, sf)
    a = f.select("image_id", "h1", "color")
    b = f.select((F.col("image_id") - 1).alias("image_id"), F.col("h1").alias("g1"), F.col("color").alias("color2"))
    return a.join(b, "image_id").select(
        "image_id", H.hamming(F.col("h1"), F.col("g1")).cast("bigint").alias("d1"), F.round(H.color_distance(F.col("color"), F.col("color2")), 6).alias("dc")
    )


S_DISTANCE = f"""WITH {FINGERPRINTS} SELECT a.image_id, bit_count(xor(a.b1::BIT,b.b1::BIT))::BIGINT AS d1,
 round(list_sum(list_transform(list_zip(a.color,b.color), lambda z: abs(z[1]-z[2]))),6) AS dc FROM fp a JOIN fp b ON b.image_id=a.image_id+1"""


def q_components(spark, sf):
    return dedup.transitive_groups(fingerprints(spark, sf), 4).select("image_id", "component", "group_size")


S_COMPONENTS = f"""WITH RECURSIVE {FINGERPRINTS},
e AS (SELECT a.image_id AS s, b.image_id AS d FROM fp a JOIN fp b ON a.image_id<>b.image_id WHERE bit_count(xor(a.b1::BIT,b.b1::BIT)) <= 4),
reach AS (SELECT DISTINCT s AS image_id, s AS root FROM e UNION SELECT e.d, r.root FROM reach r JOIN e ON e.s=r.image_id WHERE r.root < e.d),
c AS (SELECT image_id, min(root) AS component FROM reach GROUP BY 1)
SELECT image_id, component, count(*) OVER (PARTITION BY component) AS group_size FROM c"""


def _groups(spark, sf):
    return dedup.duplicate_groups(fingerprints(spark, sf), BALANCED)


def q_duplicate_groups(spark, sf):
    return _groups(spark, sf).select("group_rank", "group_id", "group_size", "member_rank", "image_id", "name")


def q_group_summary(spark, sf):
    g = _groups(spark, sf)
    return g.groupBy("group_size").agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("members"))


def q_keep_largest(spark, sf):
    """Largest member of every transitive group (ties to the first name)."""
    f = fingerprints(spark, sf)
    g = dedup.transitive_groups(f, 4).withColumnRenamed("component", "group_id").join(f.select("image_id", "name", "width", "height"), "image_id")
    return mark_all_but_largest(g, "name").select("group_id", "image_id", "retained")


S_KEEP = f"""WITH RECURSIVE {FINGERPRINTS},
e AS (SELECT a.image_id AS s, b.image_id AS d FROM fp a JOIN fp b ON a.image_id<>b.image_id WHERE bit_count(xor(a.b1::BIT,b.b1::BIT)) <= 4),
reach AS (SELECT DISTINCT s AS image_id, s AS root FROM e UNION SELECT e.d, r.root FROM reach r JOIN e ON e.s=r.image_id WHERE r.root < e.d),
c AS (SELECT image_id, min(root) AS group_id FROM reach GROUP BY 1)
SELECT group_id, image_id, row_number() OVER (PARTITION BY group_id ORDER BY width*height DESC, image_id || '.png') = 1 AS retained FROM c JOIN fp USING (image_id)"""


def _walk_sql(o: SimilarityOptions) -> str:
    """The sequential greedy run over images: seeds by falling number of links, each joined by the nearest
    free image that links to all members so far; groups in order of size, then of seeds."""
    return f"""WITH RECURSIVE pr AS ({_pair_sql(o)}),
near AS (SELECT src AS s, dst AS d, d1 FROM pr UNION ALL SELECT dst, src, d1 FROM pr),
seeds AS (SELECT s AS id, count(*) AS degree, row_number() OVER (ORDER BY count(*) DESC, s) AS place FROM near GROUP BY s),
walk AS (
  SELECT 0 AS step, []::BIGINT[] AS used, NULL::BIGINT AS seed, []::BIGINT[] AS grp, NULL::BIGINT AS added
  UNION ALL
  SELECT step+1, list_append(used, coalesce(pick,start)), CASE WHEN pick IS NULL THEN start ELSE seed END,
    CASE WHEN pick IS NULL THEN [start] ELSE list_append(grp,pick) END, coalesce(pick,start)
  FROM (SELECT w.*, (SELECT arg_min(v,(far,v)) FROM (SELECT e.d AS v, max(e.d1) AS far FROM near e WHERE list_contains(w.grp,e.s) AND NOT list_contains(w.used,e.d) GROUP BY e.d HAVING count(*)=len(w.grp))) AS pick,
      (SELECT arg_min(o.id,o.place) FROM seeds o WHERE NOT list_contains(w.used,o.id)) AS start FROM walk w) z
  WHERE coalesce(pick,start) IS NOT NULL),
member AS (SELECT w.added AS image_id, w.seed AS group_id, count(*) OVER (PARTITION BY w.seed) AS group_size FROM walk w WHERE w.added IS NOT NULL),
gr AS (SELECT m.*, 'x' AS x, s.degree FROM member m JOIN seeds s ON s.id=m.group_id WHERE group_size > 1),
info AS (SELECT doc_id AS image_id, 'doc/' || source || '/' || doc_id || '.png' AS uri, doc_id || '.png' AS name, (512 + n_chars%512) * 768 AS area FROM documents)"""


S_GROUPS = f"""{_walk_sql(BALANCED)}
SELECT (dense_rank() OVER (ORDER BY group_size DESC, degree DESC, group_id) - 1)::BIGINT AS group_rank, group_id, group_size,
 (row_number() OVER (PARTITION BY group_id ORDER BY name, image_id) - 1)::BIGINT AS member_rank, image_id, name FROM gr JOIN info USING (image_id)"""
S_SUMMARY = f"{_walk_sql(BALANCED)} SELECT group_size, count(DISTINCT group_id) AS groups, count(*) AS members FROM gr GROUP BY 1"
S_RETAINED = f"""{_walk_sql(BALANCED)},
r AS (SELECT image_id, row_number() OVER (PARTITION BY group_id ORDER BY area DESC, name, image_id) AS k FROM gr JOIN info USING (image_id))
SELECT image_id, uri FROM info WHERE image_id NOT IN (SELECT image_id FROM r WHERE k>1)"""


def q_retained(spark, sf):
    f = fingerprints(spark, sf)
    return dedup.retained_images(f, dedup.duplicate_groups(f, BALANCED)).select("image_id", "uri")


QUERIES = {
    "average_hash": (q_average_hash, S_AHASH),
    "difference_hash": (q_difference_hash, S_DHASH),
    "median_hash": (q_median_hash, S_MEDIAN),
    "wavelet_hash": (q_wavelet_hash, S_WAVELET),
    "perceptual_hash": (q_perceptual_hash, S_PHASH),
    "linear_light": (q_linear_light, S_LIGHT),
    "color_signature": (q_color_signature, S_COLOR),
    "hash_distance": (q_hash_distance, S_DISTANCE),
    "similar_pairs_strict": (_pair_query("strict"), _class_sql(SIMILARITY_PRESETS["strict"])),
    "similar_pairs_balanced": (_pair_query("balanced"), _class_sql(BALANCED)),
    "similar_pairs_expanded": (q_pairs_expanded, _pair_sql(BALANCED)),
    "similar_pairs_loose": (_pair_query("loose"), _class_sql(SIMILARITY_PRESETS["loose"])),
    "similar_pairs_wide": (q_pairs_wide, S_WIDE),
    "transitive_groups": (q_components, S_COMPONENTS),
    "keep_largest": (q_keep_largest, S_KEEP),
    "duplicate_groups": (q_duplicate_groups, S_GROUPS),
    "group_summary": (q_group_summary, S_SUMMARY),
    "retained_images": (q_retained, S_RETAINED),
}
