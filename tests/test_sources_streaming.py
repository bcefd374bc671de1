import pytest

from tessera.functions.text import canonical_json_sha256
from tessera.sources import files, pipe_text, strict_json
from tessera.streaming import quality as streamed

GOOD = b"# head\n1|1|a|b\n1|2|\xd9\x83\n# foot\n"


@pytest.mark.parametrize(
    ("content", "least"),
    [
        (GOOD, None), (b"\xef\xbb\xbf" + GOOD, "closed"), (GOOD.replace(b"\n", b"\r\n"), "closed"), (GOOD[:-1], "closed"), (GOOD + b"1|3|c\n", "closed"),
        (b"1|2|a\n1|1|b\n", "ordered"), (b"1|1|a\n1|1|b\n", "unique"), (b"x|1|a\n", "comments"), (b"1|1\n", "comments"),
    ],
)
def test_pipe_levels(content, least):
    for level in pipe_text.LEVELS:
        refused = least is not None and pipe_text.LEVELS.index(level) >= pipe_text.LEVELS.index(least)
        if refused:
            with pytest.raises(pipe_text.PipeTextError):
                pipe_text.parse_file(content, level)
        else:
            assert pipe_text.parse_file(content, level)


def test_pipe_file_and_lines(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_bytes(GOOD)
    assert rows(pipe_text.read(spark, str(tmp_path / "a.txt")), "sura", "aya", "text") == [(1, 1, "a|b"), (1, 2, "ك")]
    lines = spark.createDataFrame([("1|1|a|b",), ("#x",), ("",), ("bad",)], "value string")
    assert rows(pipe_text.parsed(lines)) == [(1, 1, "a|b"), (None, None, None)]


def test_strict_json(spark, rows):
    texts = ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": NaN}', "﻿{}", "{} x", None, ""]
    df = strict_json.with_errors(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    assert [e for _, _, e in rows(df)] == [None, "DUPLICATE_KEY", "NOT_A_NUMBER", "BOM", "NOT_JSON", "NOT_JSON", "NOT_JSON"]
    a, b = (spark.createDataFrame([(t,)], "t string").select(canonical_json_sha256("t")).first()[0] for t in ('{"b":1,"a":2}', '{"a": 2, "b": 1}'))
    assert a == b
    assert strict_json.top_level_objects('x {"a": "}"} {"b": {}} }') == [(2, 12), (13, 22)]
    assert strict_json.blind_leaks({"q": ["yes", {"Gold": 1}]}, frozenset({"gold"}), frozenset({"yes"})) == ["input.q[0]", "input.q[1].Gold"]


def test_manifest_register_and_jsonl(spark, tmp_path, rows):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), (None, "4")], "k string, digest string")
    w = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), (None, None)], "k string, digest string")
    assert rows(files.against_manifest(m, w, ["k"])) == [("b", "changed"), ("c", "unlisted"), ("d", "missing"), (None, "changed")]
    assert sorted(r.k for r in files.admitted(m.union(m), w.where("k = 'a'").select("digest"), "digest").collect() if r.k) == ["b", "c"]
    files.write_jsonl(m, str(tmp_path / "j"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "j"), "k string, digest string")) == rows(m)
    (tmp_path / "t.txt").write_text("hello")
    assert files.pinned_texts(spark, str(tmp_path / "t.txt"), {"t.txt": "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0"}).first().text == "hello"
    with pytest.raises(ValueError):
        files.pinned_texts(spark, str(tmp_path / "t.txt"), {"t.txt": "0" * 40})


def test_streams(spark, tmp_path, rows):
    src, reg = str(tmp_path / "in"), str(tmp_path / "reg")
    df = spark.createDataFrame([("a", "x", "d1"), ("a", None, "d2"), ("b", "<br>", "d1")], "source string, text string, digest string")
    df.write.parquet(src + "/tafsirs.parquet")
    got = streamed.counted_so_far(spark, src, "tafsirs", "source")
    assert rows(got, "source", "n_rows", "sql_empty", "markup_only") == [("a", 2, 1, 0), ("b", 1, 0, 1)]
    spark.createDataFrame([("old", "t", "d2")], df.schema).write.parquet(reg)
    for k in range(2):  # a second run from a fresh checkpoint adds nothing
        new = spark.readStream.schema(df.schema).parquet(src + "/tafsirs.parquet")
        streamed.admit_stream(new, reg, "digest", str(tmp_path / f"cp{k}")).awaitTermination()
        assert sorted(r.digest for r in spark.read.parquet(reg).collect()) == ["d1", "d2"]
    events = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    assert streamed.late_counts(events, "ts", "k").isStreaming
