import pytest
from pyspark.sql import functions as F

from viewloom.functions import text as T
from viewloom.operators import captions, embeds


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v STRING").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw,uid", [("a/b/c.d.e", "c"), ("plain", "plain"), ("x/.hidden", ""), ("dir/name.glb", "name"), ("end/", "")]
)
def test_norm_uid(spark, raw, uid):
    assert one(spark, T.norm_uid, raw) == uid == raw.split("/")[-1].split(".")[0]


def test_oid_of(spark):
    assert one(spark, T.oid_of, "000-011/abc.x.glb") == "abc"
    assert one(spark, T.oid_of, "a/b/c") == "b"
    assert one(spark, T.oid_of, "nothing") is None


@pytest.mark.parametrize("raw", ["  a b ", "\t\n", "", " wide　", "\x1cx\x1f", "\xa0", "keep​zero"])
def test_strip_is_python_strip(spark, raw):
    assert one(spark, T.strip, raw) == raw.strip()
    assert one(spark, T.clean_caption, raw) == (raw.strip() or "3d object")


def test_whitespace_table_is_complete():
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(T.WHITESPACE)


def test_model_caption(spark):
    assert one(spark, lambda c: T.model_caption(c, "pas"), "  A Cat ") == "a cat"
    assert one(spark, lambda c: T.model_caption(c, "sd15"), "  A Cat ") == "  A Cat "


def test_output_names(spark):
    def named(image, prompt, it):
        df = spark.createDataFrame([(image, prompt, it)], "i STRING, p STRING, n INT")
        return df.select(T.prompt_output_name(F.col("i"), F.col("p"), F.col("n"))).first()[0]

    assert named("cat", "a short one", 12) == "[cat]_[a short one...]_000012"
    assert named("", "x" * 30, 1234567) == f"[]_[{'x' * 20}...]_1234567"
    assert named("cat", "", 1) == "[cat]_[]_000001"
    df = spark.createDataFrame([(3, 12, 500)], "i INT, j INT, n INT")
    assert df.select(T.id_output_name(F.col("i"), F.col("j"), F.col("n"))).first()[0] == "003_012_000500"


def test_output_iter(spark):
    assert one(spark, T.output_iter, "/x/[a]_[b...]_013020_gs.png") == 13020
    assert one(spark, T.output_iter, "/x/a_gs.png") is None
    assert one(spark, T.output_iter, "/x/a_000001.gif") is None


def test_subset_resolution(spark, rows):
    subset = spark.createDataFrame([("1",), ("2",), ("9",)], "gid STRING")
    gidmap = spark.createDataFrame([("1", "d/a.glb"), ("2", "d/b.glb"), ("3", "d/c.glb")], "gid STRING, path STRING")
    oids = captions.resolve_subset(subset, gidmap)
    assert rows(oids) == [("1", "a"), ("2", "b")]
    assert rows(captions.unresolved_gids(subset, gidmap)) == [("9",)]
    table = spark.createDataFrame([("a", "an a")], "oid STRING, caption STRING")
    assert rows(captions.attach_captions(oids, table), "gid", "oid", "caption") == [("1", "a", "an a")]
    assert rows(captions.missing_captions(oids, table)) == [("b",)]


def test_attach_with_a_hot_oid(spark):
    oids = spark.range(3000).select(
        F.col("id").cast("string").alias("gid"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("oid")
    )
    table = spark.range(3000).select(F.col("id").cast("string").alias("oid"), F.lit("c").alias("caption"))
    table = table.unionByName(spark.createDataFrame([("hot", "h")], "oid STRING, caption STRING"))
    got = captions.attach_captions(oids, table)
    assert got.count() == 3000 and got.where("caption = 'h'").count() == 1000


def test_uid_collisions(spark, rows):
    df = spark.createDataFrame([("a/x.1",), ("b/x.2",), ("y.1",), ("y.1",)], "uid STRING")
    assert rows(captions.uid_collisions(df)) == [("x", "a/x.1", "b/x.2", 2)]


def test_caption_pairs(spark, rows):
    df = spark.createDataFrame([(b"d/u.glb", b"  "), (b"w", b" text ")], "uid BINARY, caption BINARY")
    assert rows(captions.caption_pairs(df)) == [("u", "3d object"), ("w", "text")]


EMBEDS = "model STRING, uid STRING, tokens ARRAY<ARRAY<FLOAT>>, pooled ARRAY<FLOAT>, attention_mask ARRAY<FLOAT>"


def store(spark, with_null=True):
    data = [
        ("sdxl", "u", [[1.0, 2.0], [3.0, 4.0]], [5.0, 6.0], None),
        ("pas", "u", [[7.0, 8.0]], None, [1.0]),
        ("sd15", "u", [[9.0, 9.0]], None, None),
    ]
    if with_null:
        data += [
            ("sdxl", "null", [[0.5, 0.5], [0.5, 0.5]], [0.25, 0.25], None),
            ("sd15", "null", [[0.125, 0.125]], None, None),
            ("pas", "null", [[0.75, 0.75]], None, [1.0]),
        ]
    return spark.createDataFrame(data, EMBEDS)


def test_embeddings_per_model(spark):
    samples = spark.createDataFrame([("d/u.glb",), ("d/v.glb",)], "uid STRING")
    assert embeds.attach_embeds(samples, store(spark), "sd15").columns == ["uid", "tokens"]
    assert embeds.attach_embeds(samples, store(spark), "sdxl").first().pooled == [5.0, 6.0]
    assert embeds.attach_embeds(samples, store(spark), "pas").first().attention_mask == [1.0]
    assert [r.uid for r in embeds.missing_embeds(samples, store(spark), "sd15").collect()] == ["d/v.glb"]


def test_null_embedding(spark):
    samples = spark.createDataFrame([("u",), ("w",)], "uid STRING")
    plain = embeds.attach_null(samples, store(spark), "sd15").collect()
    assert [r.null_tokens for r in plain] == [[[0.125, 0.125]]] * 2
    zeros = embeds.attach_null(samples, store(spark), "sdxl").first()
    assert zeros.null_tokens == [[0.0, 0.0], [0.0, 0.0]] and zeros.null_pooled == [0.0, 0.0]
    masked = embeds.attach_null(samples, store(spark), "pas").first()
    assert masked.null_attention_mask == [1.0] and masked.null_tokens == [[0.75, 0.75]]
    absent = embeds.attach_null(samples, store(spark, with_null=False), "sd15").collect()
    assert len(absent) == 2 and absent[0].null_tokens is None


def test_dropped_text(spark, rows):
    df = spark.createDataFrame(
        [("a", [[1.0]], [2.0], [3.0], [[0.0]], [0.5], [0.25], True), ("b", [[1.0]], [2.0], [3.0], [[0.0]], [0.5], [0.25], False)],
        "uid STRING, tokens ARRAY<ARRAY<FLOAT>>, pooled ARRAY<FLOAT>, attention_mask ARRAY<FLOAT>, "
        "null_tokens ARRAY<ARRAY<FLOAT>>, null_pooled ARRAY<FLOAT>, null_attention_mask ARRAY<FLOAT>, drop_text BOOLEAN",
    )
    columns = ("uid", "tokens", "pooled", "attention_mask")
    kept = ("b", [[1.0]], [2.0], [3.0])
    assert rows(embeds.apply_text_drop(df, "sd15"), *columns) == [("a", [[0.0]], [2.0], [3.0]), kept]
    assert rows(embeds.apply_text_drop(df, "sd3m"), *columns) == [("a", [[0.0]], [0.5], [3.0]), kept]
    assert rows(embeds.apply_text_drop(df, "pas"), *columns) == [("a", [[0.0]], [2.0], [0.25]), kept]
