import math
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.functions import metrics, stats
from quernel.functions import text as tx
from quernel.operators import sentiment

ODD = ["", " ", "\xa0a\x1c", "ß SS", "Straße", "İ ŉ ﬁ ſ", "ΑΣ Σ", "a b", "Tab\tand\nline", "Ꭰ ꭰ", None]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def each(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(f(F.col("x"))).collect()]


def test_text_functions_follow_python(spark):
    values = [v for v in ODD if v is not None]
    assert each(spark, values, tx.strip) == [v.strip() for v in values]
    assert each(spark, values, tx.casefold) == [v.casefold() for v in values]
    assert each(spark, ODD, tx.norm) == [" ".join(str(v).split()).casefold() for v in ODD]
    assert each(spark, ["Ab-1 é ab 2"], tx.tokens) == [["ab", "1", "2"]]
    assert each(spark, ["a  \r\nb\n\n\n\nc ", "\n"], tx.collapse_lines) == ["a\nb\n\nc", ""]
    assert each(spark, [b"a\xffb"], tx.decode_utf8, "binary") == ["a�b"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("aB .!?\n é", max_size=60), min_size=1, max_size=20), st.integers(1, 5))
def test_segments_keep_everything(spark, texts, cap):
    for text, got in zip(texts, each(spark, texts, lambda c: tx.segments(c, cap)), strict=True):
        assert len(got) <= cap and "".join("".join(got).split()) == "".join(text.split())


def test_segments(spark):
    cases = {
        "Rain fell.\n\nThe mill stood still.\n\nLater on.": ["Rain fell.", "The mill stood still.", "Later on."],
        "Wheels turn. Does the belt hold? It does!": ["Wheels turn.", "Does the belt hold?", "It does!"],
        "no end": ["no end"],
        "one.\n\n  \n": ["one."],
        " \n ": [],
    }
    assert each(spark, list(cases), tx.segments) == list(cases.values())
    ten = "\n\n".join(f"p{i}" for i in range(10))
    assert each(spark, [ten], lambda c: tx.segments(c, 3)) == [["p0 p1 p2 p3", "p4 p5 p6 p7", "p8 p9"]]
    units = F.array(*[F.lit(str(i)) for i in range(25)])
    assert spark.range(1).select(F.size(tx.merge_units(units, 24))).first()[0] == 13


@pytest.mark.parametrize("raw,score", [("6", 6), (" 4.5 ", 4.5), ("99", 10), ("-1e3", -10), ("n/a", 0), ("", 0), (None, 0), ("nan", 10), ("-inf", -10), ("5d", 0), ("1_0", 10), ("0x1", 0)])
def test_scores(spark, raw, score):
    assert each(spark, [raw], stats.coerce_score) == [score]


def by_integral(t, df):
    c = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2)
    n, a = 20_000, abs(t)
    f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    s = f(0) + f(a) + sum((4 if i % 2 else 2) * f(i * a / n) for i in range(1, n))
    return 1 - 2 * s * a / n / 3


def test_p_values(spark):
    cases = [(2.262157, 9), (0.0, 5), (1.0, 1), (-2.5, 2), (3.3, 23), (0.4, 100), (2.0, 40)]
    got = [r[0] for r in spark.createDataFrame(cases, "t double, df int").select(stats.t_p_value(F.col("t"), F.col("df"))).collect()]
    assert got == pytest.approx([by_integral(*c) for c in cases], abs=1e-9)
    assert abs(got[0] - 0.05) < 1e-4 and got[1] == 1
    assert spark.range(1).select(stats.t_p_value(F.lit(3.0), F.lit(0))).first()[0] == 1


def test_labels(spark):
    assert each(spark, [6.0, 2.0, 1.996, -2.0, -6.0], stats.polarity, "double") == ["very positive", "positive", "neutral / mixed", "negative", "very negative"]
    assert each(spark, [None, 0.0, 0.01, 0.05, 0.1], stats.confidence, "double") == ["insufficient-data", "high", "moderate", "low", "not-significant"]


GOLD = {"merchant": "Mill Street Hardware", "date": "2025-11-30", "amount": 1234.56}


@pytest.mark.parametrize(
    "change,hits",
    [({}, 3), ({"merchant": "Harbour Books"}, 2), ({"amount": "$1,234.56"}, 3), ({"amount": "1234.56 USD"}, 3), ({"amount": "1234.565"}, 3), ({"amount": "n/a"}, 2), ({"amount": "-"}, 2), ({"amount": None}, 2), ({"merchant": "  mill   street\thardware "}, 3), ({"date": "2025-11-3"}, 2)],
)
def test_field_hits(spark, change, hits):
    lit = lambda d: {k: F.lit(v) for k, v in d.items()}
    predicted = GOLD | {"amount": "1234.56"} | change
    predicted["amount"] = predicted["amount"] if predicted["amount"] is None else str(predicted["amount"])
    got = metrics.field_hits(lit(GOLD), {k: v.cast("string") for k, v in lit(predicted).items()})
    row = spark.range(1).select(got.alias("h"), metrics.passes_gate(got).alias("g")).first()
    assert (row["h"], row["g"]) == (hits, hits == 3)


def test_amounts(spark):
    assert spark.range(1).select(metrics.parse_amount(F.lit(True), "boolean")).first()[0] is None
    pairs = [(4.95, 4.96, True), (1.0, 1.01, False), (None, 1.0, False)]
    df = spark.createDataFrame(pairs, "a double, b double, ok boolean")
    assert all(r["ok"] == r["got"] for r in df.withColumn("got", metrics.amount_matches(F.col("a"), F.col("b"))).collect())


def test_addresses(spark):
    base = tx.api_base(F.lit("http://h:1//"))
    assert list(spark.range(1).select(base, tx.health_url(base), tx.models_url(base)).first()) == ["http://h:1/v1", "http://h:1/health", "http://h:1/v1/models"]
    names = {"a": True, "a.b-c_1": True, "../escape": False, "a/b": False, "": False, "with space": False, ".hidden/../x": False}
    assert each(spark, list(names), tx.session_name_valid) == list(names.values())


def summary(spark, samples):
    from quernel.operators.sentiment import summarize_rows, summarize_samples

    rows = summarize_rows(spark.createDataFrame([(1, samples)], "doc_id int, samples array<array<double>>")).collect()
    flat = [(1, i, j, float(x)) for i, s in enumerate(samples) for j, x in enumerate(s)]
    long = summarize_samples(spark.createDataFrame(flat, "doc_id int, seg_idx int, sample_idx int, score double")).collect()
    assert [r.asDict() for r in rows] == [pytest.approx(r.asDict()) for r in long]
    return rows[0] if rows else None


def test_summaries(spark):
    r = summary(spark, [[6.0, 7.0, 5.0], [3.0, 4.0, 2.0], [8.0, 9.0, 7.0], [1.0, 2.0, 0.0]])
    assert (r["n_segments"], r["n_samples"], r["polarity"], r["confidence"]) == (4, 12, "positive", "low")
    assert r["mean"] == 4.5 and r["volatility"] == pytest.approx(statistics.stdev([6, 3, 8, 1])) and r["model_uncertainty"] == 1
    assert (r["std_error"], r["t_statistic"], r["p_value"]) == pytest.approx((1.554563, 2.894704, 0.062772), abs=1e-6)
    assert (r["ci_low"], r["ci_high"]) == pytest.approx((1.453112, 7.546888), abs=1e-6)
    one = summary(spark, [[5.0, 5.0, 5.0], []])
    assert (one["n_segments"], one["volatility"], one["p_value"], one["ci_low"], one["confidence"]) == (1, 0, None, None, "insufficient-data")
    same = summary(spark, [[8.0]] * 3)
    assert (same["std_error"], same["t_statistic"], same["p_value"], same["confidence"], same["ci_low"]) == (0, None, 0, "high", 8)
    zero = summary(spark, [[0.0]] * 3)
    assert (zero["t_statistic"], zero["p_value"], zero["polarity"], zero["confidence"]) == (0, 1, "neutral / mixed", "not-significant")
    assert summary(spark, [[], []]) is None


def test_equal_segments_have_no_spread(spark):
    """The sum of 24 means of 23/3, divided by 24, isn't 23/3: equal means still have exactly no spread, no t and p 0."""
    rows = spark.range(1).select(F.lit(1).alias("doc_id"), F.array_repeat(F.array(*map(F.lit, (7.0, 8.0, 8.0))), 24).alias("samples"))
    long = rows.select("doc_id", F.posexplode("samples").alias("seg_idx", "s")).repartition(7).select("doc_id", "seg_idx", F.posexplode("s").alias("sample_idx", "score"))
    for found in (sentiment.summarize_rows(rows), sentiment.summarize_samples(long)):
        got = found.first()
        assert (got["volatility"], got["std_error"], got["t_statistic"], got["p_value"], got["ci_low"]) == (0.0, 0.0, None, 0.0, got["mean"])
    assert spark.createDataFrame([(23 / 3,)] * 24, "x double").repartition(7).agg(stats.sample_stdev(F.col("x"))).first()[0] == 0.0


def test_stripping_takes_no_pattern(spark):
    """White space is looked for at the ends only, and is what Python's is."""
    odd = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    rows = spark.createDataFrame([(f"{odd}a {odd} b{odd}",), (odd,), ("",), ("\u200b\u00e9 ",), (None,)], "s string").select("s", tx.strip(F.col("s")).alias("both"), tx.rstrip(F.col("s")).alias("right"))
    for r in rows.collect():
        assert (r["both"], r["right"]) == (r["s"] and r["s"].strip(), r["s"] and r["s"].rstrip())
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
