"""Whole-word run matching between collections: first shared run, spans, shared segments, cut-off tails."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.offsets import located_words
from ..functions.text import sha256
from ..plans.runtime import materialize, spread, table

WORDS = 10
#: Runs of the queried side below which it is sent to all executors; beyond, both sides are shuffled by run.
BROADCAST_RUNS = 200_000


def word_runs(texts: DataFrame, keys: list[str], words: int = WORDS) -> DataFrame:
    """(keys..., gram, phrase, pos, start_pos, end_pos): every run of `words` folded words, by word and by raw span.

    `phrase` is the 128-bit digest of the run's words with blanks between them, `gram` its first half as a number: runs
    are joined by the one and told apart by both, and no text travels with them. Shorter and null texts give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, phrase, pos, start, end = [], [], [], [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                found = located_words(text)
                for j in range(len(found) - words + 1):
                    owner.append(i)
                    phrase.append(hashlib.md5(" ".join(w for w, _, _ in found[j : j + words]).encode("utf-8", "surrogatepass")).digest())
                    pos.append(j)
                    start.append(found[j][1])
                    end.append(found[j + words - 1][2])
            gram = np.frombuffer(b"".join(phrase), "<i8")[::2] if phrase else np.empty(0, np.int64)
            of = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(of) for i in range(len(keys))), pa.array(gram), pa.array(phrase, pa.binary()), *(pa.array(x, pa.int32()) for x in (pos, start, end))],
                names=[*keys, "gram", "phrase", "pos", "start_pos", "end_pos"],
            )

    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return spread(texts.where("text is not null").select(*keys, "text")).mapInArrow(run, f"{kinds}, gram long, phrase binary, pos int, start_pos int, end_pos int")


def met_runs(asked: DataFrame, searched: DataFrame) -> DataFrame:
    """The runs of both sides joined by `gram`; column names must differ but for it.

    The asked side is written and counted: it is broadcast below BROADCAST_RUNS rows, else both sides are shuffled.
    """
    asked = materialize(asked)
    few = asked.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    return searched.join(F.broadcast(asked) if few else asked, "gram")


def links(mentions: DataFrame, blocks: DataFrame, m_key: str, source: str, b_key: str, words: int = WORDS) -> DataFrame:
    """One row per mention: (m_key, status, source, block, m_pos, b_pos).

    `CANDIDATE_MATCH` with the first source in order, its first block, and in it the earliest run of the mention at
    its earliest place; `NO_MATCH`; and where there are no blocks at all `SOURCE_UNAVAILABLE`, which is not a no.
    Blocks of an unknown (null) source are searched too and come last. The least place is kept on the map side.
    """
    m = word_runs(mentions, [m_key], words).select(m_key, "gram", F.col("phrase").alias("m_phrase"), F.col("pos").alias("m_pos"))
    b = word_runs(blocks.select(F.col(source).alias("source"), F.col(b_key).alias("block"), "text"), ["source", "block"], words).select("source", "block", "gram", "phrase", F.col("pos").alias("b_pos"))
    at = F.struct(F.col("source").isNull().alias("unknown"), "source", "block", "m_pos", "b_pos")
    first = met_runs(m, b).where("phrase = m_phrase").groupBy(m_key).agg(F.min(at).alias("first"))
    there = not blocks.where("text is not null").isEmpty()
    status = F.when(F.col("first").isNotNull(), "CANDIDATE_MATCH").otherwise("NO_MATCH" if there else "SOURCE_UNAVAILABLE")
    return mentions.select(m_key).join(first, m_key, "left").select(
        m_key, status.alias("status"), F.col("first.source").alias("source"), F.col("first.block").alias("block"), F.col("first.m_pos").alias("m_pos"), F.col("first.b_pos").alias("b_pos")
    )


def shared_segments(texts: DataFrame, key: str, source: str, least: int = 40) -> DataFrame:
    """(segment_sha256, n_texts, n_sources): paragraphs of at least `least` characters that stand in two texts or more."""
    parts = texts.where("text is not null").select(key, source, F.explode(F.split("text", "\n\n")).alias("part"))
    each = parts.where(F.length("part") >= least).groupBy(sha256(F.col("part")).alias("segment_sha256"), key, source).agg(F.lit(1))
    return each.groupBy("segment_sha256").agg(F.count(F.lit(1)).alias("n_texts"), F.count_distinct(source).alias("n_sources")).where("n_texts > 1")


def split_overlap(items: DataFrame, key: str, split: str, words: int = WORDS) -> DataFrame:
    """(id_a, id_b): items of different splits that share a run of `words` tokens, the smaller id first."""
    g = materialize(word_runs(items.where(F.col(split).isNotNull()), [key, split], words).select(key, split, "phrase").distinct())
    both = g.groupBy("phrase").agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo < hi").select("phrase")
    kept = materialize(g.join(both, "phrase"))
    a, b = kept.alias("a"), kept.alias("b")
    return a.join(b, F.expr(f"a.phrase = b.phrase and a.{key} < b.{key} and a.{split} <> b.{split}")).select(F.col(f"a.{key}").alias("id_a"), F.col(f"b.{key}").alias("id_b")).distinct()


def cutoff_tail(rows: DataFrame, anchor: int = 48, most: int = 320, continuation: int = 24) -> DataFrame:
    """`rows(..., text, witness)`: the longest tail of the text's letters (`most` down to `anchor`) that the witness has.

    Adds tail (its length, null without one), unique (it occurs once), continues (`continuation` letters follow it).
    """
    letters = lambda c: F.regexp_replace(c, r"[^\p{L}]", "")
    r = rows.withColumns({"_t": letters(F.col("text")), "_w": letters(F.col("witness"))})
    lengths = F.sequence(F.lit(most), F.lit(anchor), F.lit(-1))
    tail = F.get(F.filter(lengths, lambda n: (F.length("_t") >= n) & F.contains(F.col("_w"), F.substring(F.col("_t"), F.length("_t") - n + 1, n))), F.lit(0))
    r = r.withColumn("tail", tail).withColumn("_s", F.substring(F.col("_t"), F.length("_t") - F.col("tail") + 1, F.col("tail")))
    at = F.expr("instr(_w, _s)")
    rest = F.expr("substring(_w, instr(_w, _s) + 1)")
    return r.withColumns({
        "unique": F.col("tail").isNotNull() & ~F.contains(rest, F.col("_s")),
        "continues": F.length("_w") - (at - 1 + F.col("tail")) >= continuation,
    }).drop("_t", "_w", "_s")


def repeated_runs(texts: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """(gram_md5, n_texts): runs of `words` words that stand in two texts or more, digests instead of text.

    A text counts once for a run, so its repeats are merged on the map side before the runs are counted.
    """
    each = word_runs(texts, [key], words).select(key, "phrase").distinct()
    return each.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1").select(F.lower(F.hex("phrase")).alias("gram_md5"), "n_texts")


def _items(s, d):
    return table(s, d, "eval_items").select("item_id", "text")


QUERIES = {
    "link_spans": lambda s, d: links(_items(s, d), table(s, d, "documents"), "item_id", "source", "doc_id"),
    "link_status": lambda s, d: links(_items(s, d), table(s, d, "documents"), "item_id", "source", "doc_id").groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "shared_segments": lambda s, d: shared_segments(table(s, d, "documents"), "doc_id", "source"),
    "split_overlap": lambda s, d: split_overlap(table(s, d, "eval_items"), "item_id", "split"),
    "repeated_runs": lambda s, d: repeated_runs(table(s, d, "documents"), "doc_id"),
}
_MARKS = "||".join(f"chr({o})" for o in [*range(0x64B, 0x660), 0x670, 0x640])  # spelled out once more, independently of functions.folds
_FOLD = "trim(regexp_replace(translate(text, 'أإآىة'||" + _MARKS + r", 'اااي'||'ه'), '[\s\x{85}\p{Z}]+', ' ', 'g'))"
_TOK = lambda t, cols, part="text": f"SELECT {cols}, string_split({_FOLD.replace('text,', part + ',')}, ' ') AS t FROM {t}"
_GRAM = lambda name, src, cols: f"{name} AS (SELECT {cols}, p, array_to_string(t[p+1:p+10], ' ') AS gram FROM (SELECT {cols}, t, unnest(range(0, len(t) - 9)) AS p FROM ({src})))"
_I = _GRAM("i", _TOK("eval_items", "item_id"), "item_id")
_D = _GRAM("d", _TOK("documents WHERE text IS NOT NULL", "doc_id, source"), "doc_id, source")
_LINK = f"WITH {_I}, {_D}, m AS (SELECT item_id, source, doc_id AS block, i.p AS m_pos, d.p AS b_pos FROM i JOIN d USING (gram)), f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY source NULLS LAST, block, m_pos, b_pos) = 1), r AS (SELECT e.item_id, CASE WHEN f.item_id IS NULL THEN 'NO_MATCH' ELSE 'CANDIDATE_MATCH' END AS status, source, block, m_pos, b_pos FROM eval_items e LEFT JOIN f USING (item_id))"
SQL = {
    "link_spans": _LINK + " SELECT item_id, status, source, block, m_pos::INT AS m_pos, b_pos::INT AS b_pos FROM r",
    "link_status": _LINK + " SELECT status, count(*) AS n FROM r GROUP BY status",
    "shared_segments": "WITH p AS (SELECT doc_id, source, unnest(string_split(text, chr(10)||chr(10))) AS part FROM documents), e AS (SELECT DISTINCT sha256(part) AS segment_sha256, doc_id, source FROM p WHERE length(part) >= 40) SELECT segment_sha256, count(*) AS n_texts, count(DISTINCT source) AS n_sources FROM e GROUP BY ALL HAVING count(*) > 1",
    "split_overlap": f"WITH {_GRAM('g', _TOK('eval_items', 'item_id, split'), 'item_id, split')} SELECT DISTINCT a.item_id AS id_a, b.item_id AS id_b FROM g a JOIN g b ON a.gram = b.gram AND a.item_id < b.item_id AND a.split <> b.split",
    "repeated_runs": f"WITH {_GRAM('d', _TOK('documents WHERE text IS NOT NULL', 'doc_id'), 'doc_id')} SELECT md5(gram) AS gram_md5, count(DISTINCT doc_id) AS n_texts FROM d GROUP BY gram HAVING count(DISTINCT doc_id) > 1",
}
