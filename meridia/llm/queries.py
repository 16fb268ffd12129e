"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .embedding_duplicates import op6_embedding_duplicates
from .hard_negatives import op11_hard_negatives
from .language import op13_language
from .licenses import RULES, SENTENCES, WIDER, op4_licenses
from .mixing import op5_mixing
from .near_duplicates import op3_near_duplicates
from .quality import op7_quality
from .shards import op10_shards
from .token_counts import op8_token_counts
from .token_files import op2_token_files
from .toxicity import op9_toxicity
from .whitening import op12_whitening

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_licenses": op4_licenses,
    "op5_mixing": op5_mixing,
    "op6_embedding_duplicates": op6_embedding_duplicates,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_shards": op10_shards,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_language": op13_language,
}


def _values(rows: list[tuple]) -> str:
    quoted = ("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)
    return "VALUES " + ", ".join(quoted)


def _license_sql(gap: int = 5) -> str:
    """Rules as self-joins of the known sentences; sentences are looked for on one line each, as they stand in the tables."""
    parts = []
    for depth in sorted({len(ids) for _, _, ids in RULES}):
        rules = [(name, rule, *ids) for name, rule, ids in RULES if len(ids) == depth]
        names = ", ".join(f"s{k}" for k in range(depth))
        last, join = "f0.place", ""
        for k in range(1, depth):
            join += (
                f" JOIN LATERAL (SELECT min(g.place) AS place FROM found g WHERE g.rid = f0.rid AND g.sentence_id = r.s{k}"
                f" AND g.place > {last} AND g.place <= {last} + {gap}) f{k} ON f{k}.place IS NOT NULL"
            )
            last = f"f{k}.place"
        parts.append(
            f"SELECT f0.rid, f0.doc_id, r.license, r.rule, f0.place AS first_place, {last} AS last_place FROM found f0"
            f" JOIN ({_values(rules)}) r(license, rule, {names}) ON f0.sentence_id = r.s0{join}"
        )
    return f"""
WITH known(sentence_id, sentence) AS ({_values(SENTENCES)}),
cut AS (SELECT doc_id, row_number() OVER () AS rid, regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\r\\n\\x0B\\f]+', '\\1' || chr(10), 'g'), '(\\r?\\n)+') AS parts
  FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT doc_id, rid, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS place FROM cut),
found AS (SELECT DISTINCT doc_id, rid, CAST(place AS INTEGER) AS place, sentence_id FROM sentences JOIN known
  ON known.sentence = trim(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))
, matches AS ({" UNION ALL ".join(parts)})
SELECT doc_id, license, rule, first_place, last_place FROM matches m WHERE NOT EXISTS (SELECT 1 FROM matches l JOIN ({_values(WIDER)}) w(longer, shorter) ON l.rule = w.longer
  WHERE l.rid = m.rid AND l.first_place = m.first_place AND m.rule = w.shorter)"""


ORACLE_SQL = {
    "op4_licenses": _license_sql(),
}
