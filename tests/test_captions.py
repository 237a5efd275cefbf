"""The budget fold against a sequential walk, and string rules."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import tags as T
from lumenloom.operators import captions as C
from lumenloom.params import CaptionOptions

ITEMS = "image_id bigint, items array<struct<tag_idx:int,name:string,category:string,conf:double,route:string>>"


def tokens(tag, weighted):
    return int(len(tag.replace("_", " ").split()) * 1.3) + 1 + 6 * weighted


def walk(items, o: CaptionOptions):
    """One image, one tag at a time."""
    split = lambda s: [t.strip() for t in s.split(",") if t.strip()]
    keep = split(o.replace_underscore_excludes)
    show = lambda t: t.replace("_", " ") if o.replace_underscore and t not in keep else t
    exclude = set(split(o.exclude_tags))
    exclude |= {t.replace("_", " ") for t in exclude} if o.replace_underscore else set()
    core, extra = split(o.core_tags), split(o.additional_tags)
    banned_cats = {c.lower() for c in split(o.excluded_categories)}
    scaled = o.add_confident_as_weight or o.use_weight_mapping
    queue = [(t, o.core_tags_weight, abs(o.core_tags_weight - 1) > 0.001 or scaled) for t in core]
    model = [i for i in items if i[4] == "tags" and i[3] >= o.threshold and i[2] not in banned_cats and not {i[1], show(i[1])} & (exclude | set(core))]
    for _, name, _, conf, _ in sorted(model, key=lambda i: -i[3]):
        share = min(1.0, max(0.0, (conf - o.threshold) / (1 - o.threshold + 1e-5))) ** o.weight_mapping_exponent
        queue.append((name, o.weight_min + share * (o.weight_max - o.weight_min) if scaled else 1.0, scaled))
    room = o.token_limit - sum(tokens(t, False) for t in extra)
    used, chosen = 0, []
    for tag, weight, weighted in queue:
        cost = tokens(tag, weighted)
        if o.token_limit > 0 and used + cost > room:
            continue
        used += cost
        text = show(tag)
        chosen.append(f"({text}:{weight:.{o.tag_precision}f})" if weighted and abs(weight - 1) > 0.001 else text)
        if 0 < o.max_tags <= len(chosen):
            break
    out = list(dict.fromkeys([show(t) for t in extra] + chosen))
    return ", ".join(sorted(out) if o.sort_alphabetical else out), used + sum(tokens(t, False) for t in extra)


@pytest.mark.parametrize(
    "o",
    [
        CaptionOptions(),
        CaptionOptions(token_limit=20, max_tags=6, sort_alphabetical=True),
        CaptionOptions(additional_tags="best_quality, a_b", core_tags="w3_x, zz", core_tags_weight=1.3, token_limit=40),
        CaptionOptions(use_weight_mapping=True, weight_mapping_exponent=2.0, weight_min=0.7, weight_max=1.4, tag_precision=3, token_limit=120, exclude_tags="w5_y"),
        CaptionOptions(add_confident_as_weight=True, excluded_categories="artist, META", replace_underscore=False, token_limit=0),
    ],
)
def test_fold_equals_sequential_walk(spark, o):
    rng = random.Random(7)
    rows = []
    for image in range(60):
        items = []
        for i in range(rng.randint(0, 40)):
            name = "_".join(rng.choice(["w", "x", "yy", "long tag"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 4)))
            items.append((i, name, rng.choice(["general", "artist", "meta"]), round(rng.random(), 3), rng.choice(["tags", "tags", "rating"])))
        rows.append((image, items))
    got = {r["image_id"]: (r["caption"], r["n_tags"]) for r in C.with_captions(spark.createDataFrame(rows, ITEMS), o).collect()}
    for image, items in rows:
        caption, spent = walk(items, o)
        assert got[image][0] == caption
        assert o.token_limit == 0 or spent <= max(o.token_limit, 0)


def test_presets_as_rows_equal_presets_as_literals(spark):
    rows = [(1, [(0, "a_b", "general", 0.9, "tags"), (1, "c", "general", 0.4, "tags")])]
    scored = spark.createDataFrame(rows, ITEMS)
    presets = [CaptionOptions(name="x"), replace(CaptionOptions(name="y"), threshold=0.5, replace_underscore=False)]
    table = spark.createDataFrame([{k: v for k, v in p.__dict__.items()} for p in presets])
    out = C.with_captions(C.under_presets(scored, table), C.column_options("preset."))
    got = {r["name"]: r["caption"] for r in out.select("preset.name", "caption").collect()}
    assert got == {p.name: C.with_captions(scored, p).first()["caption"] for p in presets}


def test_no_shuffle_when_captioning(spark):
    d = spark.createDataFrame([(i, f"t{i}", "general") for i in range(8)], "tag_idx int, name string, category string")
    scores = spark.range(100).select(F.col("id").alias("image_id"), F.array(*[F.lit(float(i)) for i in range(8)]).alias("logits"))
    out = C.with_captions(C.score_items(scores, d), CaptionOptions())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_weight_rounding_follows_the_binary_value(spark):
    df = spark.createDataFrame([(1.005,), (1.05,), (0.875,)], "w double")
    got = [r[0] for r in df.select(T.weighted_text(F.lit("t"), F.col("w"), F.lit(True), F.lit(2))).collect()]
    assert got == ["(t:1.00)", "(t:1.05)", "(t:0.88)"]
    every = [(0.8 + i * 1e-4,) for i in range(5001)] + [(0.125,), (0.375,), (0.995,), (0.815,)]
    got = [r[0] for r in spark.createDataFrame(every, "w double").select(T.weighted_text(F.lit("t"), F.col("w"), F.lit(True), F.lit(2)).alias("x"), "w").collect()]
    assert got == [f"(t:{w:.2f})" if abs(w - 1) > 0.001 else "t" for (w,) in every]


def test_names_and_paths(spark):
    df = spark.createDataFrame([("zip:///d/a.zip::in/b.PNG",), ("/d/x.tar.webp",), ("/d.e/plain",), ("/d/.png",)], "u string")
    rows = df.select(T.display_name(F.col("u")).alias("n"), T.media_type(F.col("u")).alias("m"), T.stem(F.col("u")).alias("s"), T.extension(F.col("u")).alias("e")).collect()
    assert [tuple(r) for r in rows] == [
        ("[ZIP] a.zip/in/b.PNG", "image/png", "zip:///d/a.zip::in/b", "png"),
        ("x.tar.webp", "image/webp", "/d/x.tar", "webp"),
        ("plain", "image/jpeg", "/d.e/plain", ""),
        (".png", "image/jpeg", "/d/.png", ""),
    ]
