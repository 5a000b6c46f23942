"""Golden values of scalar, vector and chunking functions."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.functions import vectors as V
from lodestone.operators import chunking as C
from lodestone.operators.tasks import Limit, advance, outcome_of
from lodestone.plans import advisor


def one(spark, column, **values):
    row = spark.range(1).select(*[(v if not isinstance(v, (str, int, float)) else F.lit(v)).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first().x


def test_clock_and_durations(spark):
    for ms, want in ((3_661_000, "010101"), (59_999, "000059"), (360_000_000, "1000000")):
        assert one(spark, S.clock(F.lit(ms))) == want
    assert one(spark, S.duration_seconds(F.lit("1:02:03"))) == 3723.0 and one(spark, S.duration_seconds(F.lit("x"))) is None


def test_service_types(spark):
    for name, want in (("text_to_speech", "TextToSpeech"), ("OCR", "OCR"), ("ocr", "Chat"), ("bogus", "Chat")):
        assert one(spark, S.service_type(F.lit(name))) == want
    assert one(spark, S.service_group(F.lit("OCR"))) == "Vision" and one(spark, S.service_group(F.lit("?"))) == "Unknown"


@pytest.mark.parametrize("text,want", [("1,2,3,4", (1, 2, 3, 4)), ("10,20;4,5", (4, 5, 6, 15)), ("a,b,c,d", None), ("1,2,3", None), ("", None), (" 1 , 2,3 ,4", (1, 2, 3, 4)), ("1,2,3;4", None)])
def test_regions(spark, text, want):
    got = one(spark, S.region(F.lit(text)))
    assert (tuple(got) if got else None) == want


def test_names_and_paths(spark):
    assert tuple(one(spark, S.provider_and_model(F.lit("modelhub/x/y")))) == ("modelhub", "x/y")
    assert all(one(spark, S.provider_and_model(F.lit(s))) is None for s in ("/x", "x/", "x"))
    assert one(spark, S.suffix(F.lit("/a.b/C.tar.GZ"))) == "gz" and one(spark, S.base_name(F.lit("/a.b/C.tar.GZ"))) == "C" and one(spark, S.suffix(F.lit("/a.b/none"))) == ""
    assert one(spark, S.document_type(F.lit("/x/y.DOCX"))) == "office"
    assert one(spark, S.sanitise_file_name(F.lit('a/b:c*"'))) == "a_b_c__"
    assert one(spark, S.unicode_trim(F.lit("　 a b "))) == "a b" and one(spark, S.simplify(F.lit(" a \n\t b "))) == "a b"
    allowed = lambda p: one(spark, S.path_allowed(F.lit(p), ["/tmp"]))
    assert allowed("/home/a") and not allowed("/tmp/a") and not allowed("/home/.x") and not allowed("/a" * 21)


def test_payloads_and_json(spark):
    assert one(spark, S.sse_payloads(F.lit('data: {"a":1}\n\ndata: [DONE]\ndata: {"b":{"c":2}}\n'))) == ['{"a":1}', '{"b":{"c":2}}']
    assert one(spark, S.functions_valid(F.lit('[{"name":"f"}]'))) and not any(one(spark, S.functions_valid(F.lit(s))) for s in ("[]", "{", '[{"x":1}]'))
    assert one(spark, S.image_format(F.lit("JPEG"))) == "jpg" and one(spark, S.image_format(F.lit("psd"))) is None
    assert one(spark, S.without_keys(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), ["a"])) == {"b": 2}
    assert one(spark, S.html_to_text(F.lit("<p>a &amp; b</p><script>x</script><!-- c -->d"))) == "a & b d"
    boxes = F.array(F.struct(F.lit("t").alias("text"), *[F.lit(v).alias(k) for k, v in (("x", 1), ("y", 2), ("width", 3), ("height", 4), ("angle", 0))]))
    assert '"points":[{"x":1,"y":2},{"x":4,"y":2},{"x":4,"y":6},{"x":1,"y":6}]' in one(spark, S.ocr_result(boxes))


def test_predicates(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    assert one(spark, S.stage_ready(words("a"), words("a", "b"))) and not one(spark, S.stage_ready(words("a", "c"), words("a"))) and one(spark, S.stage_ready(words(), words()))
    assert one(spark, S.stage_results_valid(F.create_map(F.lit("k"), F.lit("v")), ["k"])) and not one(spark, S.stage_results_valid(F.create_map(F.lit("k"), F.lit("")), ["k"]))
    assert one(spark, S.providers_or_default(words("b", "a", "b"), ["x"])) == ["a", "b"] and one(spark, S.providers_or_default(words(), ["x"])) == ["x"]
    assert one(spark, S.look_up(F.lit("ERNIE"), {"ernie": "/e"})) == "/e" and one(spark, S.look_up(F.lit("?"), {"ernie": "/e"})) == ""
    assert one(spark, S.progress(F.lit(1), F.lit(4))) == 25.0 and one(spark, S.progress(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, S.looks_textual(F.lit("é".encode()))) and not one(spark, S.looks_textual(F.lit(b"a\x00"))) and not one(spark, S.looks_textual(F.lit(b"\xff")))


def test_frames(spark):
    sizes = lambda n: [len(x) for x in one(spark, S.frames(F.lit(b"a" * n)))]
    assert sizes(20_000) == [8000, 8000, 4000] and sizes(0) == [] and sizes(8000) == [8000]


def test_vectors(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v]).cast("array<float>")
    assert one(spark, V.normalise(arr(3, 4))) == pytest.approx([0.6, 0.8]) and one(spark, V.normalise(arr(0, 0))) == [0.0, 0.0]
    for s, d in ((1, 0), (0.5, 1), (0, 2**0.5), (-1, 2)):
        assert one(spark, V.similarity_to_distance(F.lit(float(s)))) == pytest.approx(d)
    assert one(spark, V.squared_distance(arr(1, 2), arr(4, 6))) == 25 and one(spark, V.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, V.valid(arr(1, 2), 2)) and not one(spark, V.valid(arr(1, 2), 3)) and not one(spark, V.valid(F.array().cast("array<float>")))


def test_advisor(spark):
    for n, d, want in ((999, 64, "Flat"), (1000, 64, "HNSW"), (99_999, 64, "HNSW"), (100_000, 512, "IVF"), (100_000, 513, "IVFPQ")):
        assert one(spark, advisor.index_type(F.lit(n), F.lit(d))) == want
    for n, want in ((100_000, 2564), (200_000, 4096)):
        assert one(spark, advisor.index_parameters(F.lit("IVF"), F.lit(n), F.lit(64)))["nlist"] == want


FIXED = [
    ("", []), ("a" * 50, [(0, 50)]), ("a" * 51, [(0, 51), (1, 51)]), ("a" * 100, [(0, 100), (50, 100)]), ("a" * 512, [(0, 512), (462, 512)]),
    ("a" * 513, [(0, 512), (462, 513), (463, 513)]), ("a" * 600, [(0, 512), (462, 600), (550, 600)]), ("1" * 600, [(0, 512), (462, 600), (550, 600)]),
    ("x" * 300 + " " + "y" * 400, [(0, 301), (251, 701), (651, 701)]), ("ab " + "c" * 600, [(0, 50), (462, 603), (553, 603)]),
]


@pytest.mark.parametrize("text,want", FIXED)
def test_fixed_chunks(text, want):
    assert list(C.fixed_spans(text, C.PIPELINE, regex.compile(C.BREAK))) == want


def test_fixed_chunks_cover_text_when_resumed():
    rng = random.Random(4)
    config = C.ChunkConfig(60, 10, 10, resume_at_cut=True)
    for _ in range(200):
        text = "".join(rng.choice("abcde. ,\n") for _ in range(rng.randint(0, 400)))
        spans = list(C.fixed_spans(text, config, regex.compile(C.BREAK)))
        assert {k for a, b in spans for k in range(a, b)} == set(range(len(text))) and all(b - a <= 60 for a, b in spans)


def test_other_chunkers(spark):
    docs = lambda *t: spark.createDataFrame([(k, x) for k, x in enumerate(t)], "doc_id long, text string")
    texts = lambda rows: [r.content for r in rows.orderBy("doc_id", rows.columns[1]).collect()]
    assert texts(C.chunk_sliding(docs("abcdefghijklmnop"), C.ChunkConfig(10, 4, 3))) == ["abcdefghij", "ghijklmnop", "mnop"]
    assert texts(C.chunk_sentences(docs("Aa bb. Cc dd! Ee"), C.ChunkConfig(8, 0, 1))) == ["Aa bb", "Cc dd Ee"]
    assert texts(C.chunk_paragraphs(docs("a\n\nbb\n\n\n\nccc"), C.ChunkConfig(6, 0, 1))) == ["a\n\nbb", "ccc"]
    assert C.chunk(docs("abc"), "sentence", C.ChunkConfig(8)).count() == 0
    assert texts(C.chunk(docs("a b", None, ""), "fixed_size")) == ["a b"]


@pytest.mark.parametrize(
    "text,want",
    [("a" * 150, [150]), ("a" * 250, [250]), ("a" * 300, [300]), ("a" * 600, [300, 300]), ("a" * 700, [300, 400]), ("a" * 120 + "." + "b" * 120, [240]), ("a" * 250 + "," + "b" * 250, [250, 250]), ("a" * 120 + "." + "b" * 190, [310]), ("abc.def", [6]), ("...", [0])],
)
def test_legacy_split(spark, text, want):
    assert [len(x) for x in one(spark, C.legacy_split(F.lit(text)))] == want


def test_legacy_split_writes_double_quotes_and_single_spaces(spark):
    assert one(spark, C.legacy_split(F.lit("it's \n​ a"))) == ['it"s a']
    named = C.chunk_legacy(spark.createDataFrame([(1, "x")], "doc_id long, text string"), name=F.lit("a long file name"))
    assert [r.content for r in named.collect()] == ["a long file name", "x"]


def test_throttle():
    def run(steps, start=5):
        limit, at, out = Limit(level=start), 0, []
        for ok, code in steps:
            at += 6000
            limit = advance(limit, at, outcome_of(ok, code))
            out.append(limit.level)
        return out

    assert run([(True, 200)] * 10)[-1] == 5
    assert run([(True, 200)] * 10 + [(False, 429)] * 5)[-5:] == [4, 3, 2, 1, 1]
    assert run([(True, 200)] * 10, start=10)[-1] == 11
    quick = advance(Limit(level=10), 0, "refused")
    assert quick.level == 8 and advance(quick, 1000, "refused") == quick and advance(quick, 5000, "refused").level == 6
    runs = advance(advance(Limit(), 0, "success"), 1, "failed")
    assert (runs.successes, runs.refusals, runs.changed_ms) == (1, 0, None) and advance(runs._replace(refusals=2), 2, "failed").refusals == 0


@pytest.mark.parametrize("metric,want", [("l2", 5.0), ("inner_product", -11.0), ("cosine", -10.0)])
def test_pairwise_distance_metrics(spark, metric, want):
    vector = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.distance(vector(1, 2), vector(5, 5) if metric == "l2" else vector(3, 4), metric)) == want
    assert one(spark, V.distance(vector(1, 2), vector(1), metric)) == 3.4028234663852886e38
