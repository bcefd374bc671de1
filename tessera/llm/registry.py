"""All registered queries of this subpackage, and SQL for those that SQL can say (tests/llm covers the others)."""

import unicodedata

from . import leakage, lookalike, mixing, sentences, spam, spans, truncation

QUERIES = {
    "p1_found": spans.p1_found,
    "p1_links": spans.p1_links,
    "p1_shares": spans.p1_shares,
    "p4_found": lookalike.p4_found,
    "p4_classes": lookalike.p4_classes,
    "p5_found": truncation.p5_found,
    "p5_rates": truncation.p5_rates,
    "p6_found": sentences.p6_found,
    "p7_found": leakage.p7_found,
    "p7_items": leakage.p7_items,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": spam.p9_found,
}
_WINDOWS = """
WITH t AS (SELECT tafsir_id, text, length(text) AS n FROM tafsirs WHERE text IS NOT NULL),
w AS (SELECT tafsir_id, p, md5(substr(text, p + 1, 150)) AS h FROM (SELECT tafsir_id, text, unnest(range(0, n - 149)) AS p FROM t WHERE n >= 150)),
g AS (SELECT h FROM w GROUP BY h HAVING min(tafsir_id) < max(tafsir_id)),
s AS (SELECT DISTINCT tafsir_id, p, h FROM w JOIN g USING (h))
"""


def _folded_words() -> str:
    """An SQL expression for the folded words of `text`, by other means than the operator's: one character at a time, marks by `strip_accents`."""
    plain = {}
    for o in [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]:
        c = chr(o)
        if unicodedata.decomposition(c).startswith("<") and len(x := unicodedata.normalize("NFKD", c).replace("'", "")) == 1 and x != c:
            plain[c] = x
    unseen = r"[\p{M}\x{AD}\x{61C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]"
    same = f"translate(text, '{''.join(plain)}', '{''.join(plain.values())}')"
    many = same
    for ligature in "ﬀﬁﬂﬃﬄﻻﻼﻷﻸﻹﻺﻵﻶ":
        many = f"replace({many}, '{ligature}', '{unicodedata.normalize('NFKD', ligature)}')"
    return rf"regexp_extract_all(regexp_replace(replace(replace(replace(lower(strip_accents(regexp_replace({many}, '{unseen}', '', 'g'))), 'ß', 'ss'), 'ς', 'σ'), 'ı', 'i'), '{unseen}', '', 'g'), '[\p{{L}}\p{{N}}]+')"


_LEAKS = f"""WITH d AS (SELECT doc_id, {_folded_words()} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), i AS (SELECT item_id, {_folded_words()} AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, m, w[p:p + m - 1] AS gram FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM g), h AS (SELECT DISTINCT doc_id, m, w[p:p + m - 1] AS gram FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, m WHERE len(w) >= m)),
l AS (SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (m, gram))
"""

SQL: dict[str, str] = {
    "p7_found": _LEAKS + "SELECT doc_id, item_id FROM l",
    "p7_items": _LEAKS + "SELECT item_id, benchmark_id, split, coalesce(n, 0) AS n_docs FROM eval_items LEFT JOIN (SELECT item_id, count(*) AS n FROM l GROUP BY item_id) USING (item_id)",
    "p1_found": _WINDOWS + "SELECT DISTINCT a.tafsir_id AS id_a, b.tafsir_id AS id_b FROM s a JOIN s b ON a.h = b.h AND a.tafsir_id < b.tafsir_id",
    "p1_links": _WINDOWS + """, c AS (SELECT min(tafsir_id) AS rep, list(tafsir_id) AS ids FROM t WHERE n >= 150 GROUP BY text)
SELECT DISTINCT 'pair' AS kind, least(a.tafsir_id, b.tafsir_id) AS id_a, greatest(a.tafsir_id, b.tafsir_id) AS id_b FROM s a JOIN s b ON a.h = b.h AND a.tafsir_id < b.tafsir_id JOIN c x ON x.rep = a.tafsir_id JOIN c y ON y.rep = b.tafsir_id
UNION ALL SELECT 'member', rep, id FROM (SELECT rep, unnest(ids) AS id FROM c) WHERE id <> rep""",
    "p1_shares": _WINDOWS
    + """, e AS (SELECT tafsir_id, p, max(p + 150) OVER (PARTITION BY tafsir_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
c AS (SELECT tafsir_id, sum(150 - greatest(0, coalesce(reach, 0) - p)) AS shared, count(*) FILTER (reach IS NULL OR p > reach) AS runs FROM e GROUP BY tafsir_id)
SELECT tafsir_id, n AS n_chars, coalesce(shared, 0)::BIGINT AS shared_chars, coalesce(runs, 0) AS n_runs FROM t LEFT JOIN c USING (tafsir_id)""",
}
