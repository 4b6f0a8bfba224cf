import random

from pyspark.sql import functions as F

from marginalia.functions import places, text, vectors


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_fingerprint_ignores_cosmetics(spark):
    same = ["# TODO: fix the retry loop", "#   TODO:   fix the retry   loop", "# todo: Fix The Retry Loop", "# TODO: fix the retry loop.", "// TODO: fix the retry loop"]
    rows = column(spark, [*same, "# FIXME: fix the retry loop"]).select(text.fingerprint(F.col("x")).alias("p")).collect()
    assert len({r.p for r in rows[:5]}) == 1 and rows[5].p != rows[0].p
    cases = {"/** documents foo */": "documents foo", '"""module docstring"""': "module docstring", "// first line\n// second line": "first line second line", "": ""}
    out = column(spark, list(cases)).select("x", text.normalize(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in out} == cases


def test_fingerprint_property(spark):
    rng = random.Random(3)
    words = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(4)) for _ in range(20)]
    df = spark.createDataFrame([("# " + w, "//   " + w.upper() + "  .") for w in words], "a string, b string")
    assert df.where(text.fingerprint(F.col("a")) != text.fingerprint(F.col("b"))).count() == 0


def test_fnv(spark):
    def fnv(s):
        h = 0x811C9DC5
        for b in s.encode():
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return h

    words = ["", "a", "foobar", "überall", "💩"]
    assert [r.h for r in column(spark, words).select(text.fnv1a(F.col("x")).alias("h")).collect()] == [fnv(w) for w in words]


def test_places(spark):
    cases = [
        ("ab\ncd", "0-based-utf8", 1, 0, 3), ("ab\ncd", "1-based-utf8", 1, 1, 0), ("ab\ncd", "1-based-utf8", 2, 1, 3),
        ("💩x", "1-based-utf16", 1, 3, 4), ("💩x", "1-based-utf16", 1, 2, None), ("é!", "1-based-char", 1, 2, 2), ("é!", "1-based-utf8", 1, 3, 2),
        ("é!", "1-based-utf8", 1, 2, None), ("a\r\nbc", "1-based-utf8", 2, 1, 3), ("abc", "1-based-utf8", 5, 1, None), ("abc", "1-based-utf8", 1, 99, None),
        ("abc", "1-based-utf8", 1, 0, None), ("abc", "1-based-utf8", 1, 4, 3),
    ]
    for content, system, line, at, byte in cases:
        row = spark.createDataFrame([(content, line, at)], "t string, l int, c int").select(places.byte_offset(F.col("t"), F.col("l"), F.col("c"), system).alias("b")).first()
        assert row.b == byte, (content, system, line, at)


def test_small_functions(spark):
    df = column(spark, ["x, y", 'say "hi"', "plain", "a|b\nc", None])
    assert [r[0] for r in df.select(text.csv_field(F.col("x"))).collect()] == ['"x, y"', '"say ""hi"""', "plain", '"a|b\nc"', None]
    assert df.select(text.markdown_cell(F.col("x"))).collect()[3][0] == "a\\|b c"
    first = column(spark, ["\n  a0 \nb", "", None]).select(text.first_line(F.col("x")).alias("a"), text.first_line(F.col("x"), blank=False).alias("b")).collect()
    assert [(r.a, r.b) for r in first] == [("", "a0"), ("", None), (None, None)]
    d = column(spark, ["# marginalia:disable-line=D417,x", "/* marginalia:disable-file*/", "# marginalia:nothing", "# none"]).select(text.directive(F.col("x"), "marginalia").alias("d")).collect()
    assert [(r.d and (r.d.verb, r.d.targets)) for r in d] == [("disable-line", ["D417", "x"]), ("disable-file", []), None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, t string")
    out = {r.id: r.vector for r in vectors.hash_embedding(texts, "id", "t").collect()}
    assert len(out) == 3 and abs(sum(x * x for x in out[1]) - 1) < 1e-9 and not any(out[2])
