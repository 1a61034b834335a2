"""Text, scoring and vector expressions against plain Python."""

import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memloom.functions import scoring as S
from memloom.functions import text as X
from memloom.functions import vectors as V
from memloom.functions.keys import has_value, trimmed, unit_interval


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, value, column, kind="string"):
    return values(spark, [(value,)], f"x {kind}", column)[0][0]


@pytest.mark.parametrize(
    "name, want",
    [("HTTPServer", "http server"), ("FTS5Table", "fts5 table"), ("snake_case-kebab.dot", "snake case kebab dot"), ("workerPool2", "worker pool2"), ("", ""), (None, None)],
)
def test_decompose(spark, name, want):
    assert one(spark, name, X.decompose_identifier("x")) == want


def test_keys(spark):
    h = hashlib.sha256(b"Ab c").hexdigest()
    assert one(spark, " Ab c\t", X.memory_key("x")) == "m_" + h[:12]
    assert one(spark, " Ab c\t", X.lesson_fingerprint("x")) == "lsn_" + hashlib.sha256(b"ab c").hexdigest()[:16]
    assert one(spark, "Ab", X.node_key("x", F.lit("T"))) == hashlib.sha256(b"Ab|T").hexdigest()[:24]


def test_normalize_entity(spark):
    assert one(spark, "И. Пётр-Иванов, ООО «Ёж»", X.normalize_entity("x")) == "петриванов ооо еж"


def sentences(text):
    out, last = [], 0
    for m in re.finditer(r"[.!?…]\s+|\n+", text):
        out.append(text[last : m.end()].strip())
        last = m.end()
    return [s for s in [*out, text[last:].strip()] if s]


def chunks(text, most, overlap):
    parts = [s[i : i + most] for s in sentences(text) for i in range(0, len(s), most)]
    out, cur = [], ""
    for s in parts:
        joined = f"{cur} {s}" if cur else s
        if len(joined) > most and cur:
            out.append(cur)
            cur = f"{cur[-overlap:]} {s}" if overlap else s
        else:
            cur = joined
    return [*out, cur] if cur.strip() else out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\nЖ…", max_size=80), min_size=1, max_size=6))
def test_sentences_and_chunks(spark, texts):
    got = values(spark, [(t,) for t in texts], "x string", X.split_sentences("x"), X.split_into_chunks("x", 20, 5))
    for t, (s, c) in zip(texts, got):
        assert s == sentences(t)
        assert c == chunks(t, 20, 5)


def test_windows_and_scoped_chunks(spark):
    text = "\n".join(map(str, range(10)))
    assert one(spark, text, X.fixed_window_chunks("x", 4, 1)) == ["0\n1\n2\n3", "3\n4\n5\n6", "6\n7\n8\n9"]
    assert one(spark, "", X.fixed_window_chunks("x", 4, 1)) == [""]
    assert one(spark, text, X.scoped_chunk(F.lit("a.py"), F.lit("f"), "x", 18)) == "// a.py :: f\n0\n1\n2"


def test_masks(spark):
    text = "a  sk-abcdefghijklmnop1 ghp_ABCDEFGHIJKLMNOPQRST1\nhttps://u:p@h/x API_KEY=1 Bearer tok api.key=v sk-short token = x https://h/?a=TOKEN=1"
    want = "a  [REDACTED:sk-key] [REDACTED:gh-token]\nhttps://[REDACTED]@h/x API_KEY=[REDACTED] Bearer [REDACTED:bearer] api.key=[REDACTED:vault] sk-short token = x https://h/?a=TOKEN=1"
    assert one(spark, text, X.mask_secrets("x", ["api.key"])) == want


def test_small_ones(spark):
    assert one(spark, "x" * 10, X.trim_chars("x", 4)) == "xxxx…"
    assert one(spark, "ab", X.estimate_tokens("x")) == 1
    assert one(spark, "/Users/{id}/Posts/<n>/", X.normalize_api_path("x")) == "/users/:param/posts/:param"
    assert one(spark, "In production and DEV, not in develop", X.mentioned_environments("x")) == ["dev", "prod"]
    assert one(spark, "v1.20 port 8080", X.numbers_in("x")) == ["1", "20", "8080"]
    assert one(spark, "see AuthService, src/a.rs: or b_c x", X.named_entities("x")) == ["authservice", "b_c", "src/a.rs"]
    assert one(spark, "N/A ", has_value("x")) is False and one(spark, None, has_value("x")) is False and one(spark, " x", has_value("x")) is True
    assert one(spark, " \t x　", trimmed("x")) == "x"
    assert one(spark, float("nan"), unit_interval("x"), "double") is None and one(spark, 1.5, unit_interval("x"), "double") is None


def test_scores(spark):
    assert one(spark, "2026-01-01 00:00:00", S.recency_boost(F.lit(None).cast("timestamp"), F.col("x").cast("timestamp"), "2026-04-11 00:00:00")) == pytest.approx(0.5)
    assert one(spark, "2026-01-01 00:00:00", S.recency_decay(F.col("x").cast("timestamp"), "2026-04-01 12:00:00")) == pytest.approx(math.exp(-1))
    assert one(spark, 49, S.access_saturation("x"), "long") == pytest.approx(1.0) and one(spark, 10**6, S.access_saturation("x"), "long") == 1.0
    assert one(spark, 0, S.seed_weight(10, "x", F.lit(1.0)), "long") == pytest.approx(math.log(11))
    assert S.kind_weights_of("broken") == S.KIND_WEIGHTS and S.kind_weights_of('{"A": 2, "b": -1, "c": "x"}') == {"a": 2.0}
    assert one(spark, "Causes", S.kind_weight("x")) == 0.8 and one(spark, "other", S.kind_weight("x")) == 0.5
    w = S.usage_edge_weight(F.lit(1.0), F.lit(0), F.col("x"), F.lit(False), F.lit(100.0), F.lit(1.0))
    assert one(spark, 0, w, "long") == pytest.approx(1.0)  # in grace: no decay
    assert one(spark, 10, w, "long") == pytest.approx((1 + math.log(11) * 0.5) * math.exp(-1.5))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((2, 70)).astype("f4")
    rows = [([float(x) for x in a], [float(x) for x in b])]
    cos, q, mask, ham = values(spark, rows, "a array<float>, b array<float>", V.cosine("a", "b"), V.int8_quantize("a"), V.sign_mask("a"), V.hamming(V.sign_mask("a"), V.sign_mask("b")))[0]
    assert cos == pytest.approx(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), abs=1e-6)
    assert np.abs(np.array(q["q"]) * q["scale"] - a).max() <= q["scale"] * 0.51
    bits = [(mask[i // 64] >> (i % 64)) & 1 for i in range(70)]
    assert bits == [int(x > 0) for x in a] and len(mask) == 2
    assert ham == int(((a > 0) != (b > 0)).sum())
    zero = values(spark, [([0.0], [1.0], [1.0, 2.0])], "a array<float>, b array<float>, c array<float>", V.cosine("a", "b"), V.cosine("b", "c"), V.int8_quantize("a")["scale"])
    assert zero == [(0.0, 0.0, 1.0)]
