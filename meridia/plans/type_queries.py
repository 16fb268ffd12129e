"""Queries on the assignability of types, which are lifted from the properties of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import type_relation
from . import lifts
from .registry import query


def types(spark, sf_dir):
    """For each number that events hold a scalar, an array of it, an object with both, a union of all three and of another scalar; and "any"."""
    k = lifts.table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).where("k IS NOT NULL").distinct()
    name = lambda letter, number=F.col("k"): F.concat(F.lit(letter), number.cast("string"))
    n, text, whole = F.col("k"), F.lit(None).cast("string"), F.lit(None).cast("int")
    semantic = F.when(n % 3 != 0, F.concat(F.lit("s"), (n % 2).cast("string")))
    row = lambda id_, kind, semantic=text, media=text, least=whole, most=whole, open_=F.lit(False): F.struct(
        id_.alias("id"), kind.alias("kind"), semantic.alias("semantic"), media.alias("media"), least.cast("int").alias("least"), most.cast("int").alias("most"), open_.alias("open")
    )
    scalar = F.element_at(F.array(*map(F.lit, ("null", "boolean", "number", "string", "binary"))), (n % 5 + 1).cast("int"))
    each = k.select(F.explode(F.array(
        row(name("S"), scalar, semantic, F.when(n % 4 != 0, F.concat(F.lit("m"), (n % 2).cast("string")))),
        row(name("A"), F.lit("array"), least=F.when(n % 2 == 0, n % 3), most=F.when(n % 5 != 0, n % 7 + 2)),
        row(name("O"), F.lit("object"), semantic=F.when(n % 2 == 0, F.concat(F.lit("s"), (n % 3).cast("string"))), open_=n % 3 == 1),
        row(name("U"), F.lit("union")),
    )).alias("t")).select("t.*")
    anything = spark.range(1).select(row(F.lit("any"), F.lit("any")).alias("t")).select("t.*")
    part = lambda id_, part, label=text, required=F.lit(True): F.struct(id_.alias("id"), label.alias("name"), part.alias("part"), required.alias("required"))
    parts = k.select(F.explode(F.array(
        part(name("A"), name("S")), part(name("O"), name("S"), F.lit("p0"), n % 2 == 0), part(name("O"), name("A"), F.lit("p1"), n % 3 == 0),
        part(name("O"), F.when(n % 4 == 1, name("S")), F.concat(F.lit("q"), (n % 8).cast("string")), n % 16 == 1),
        part(name("U"), name("S")), part(name("U"), name("A")), part(name("U"), name("O")), part(name("U"), name("S", n * 7 % 100)),
    )).alias("p")).select("p.*").where("part IS NOT NULL")
    all_types = each.unionByName(anything)
    return all_types, parts.join(all_types.select(F.col("id").alias("part")), "part", "left_semi")


#: the relation by levels: scalars, arrays of them, objects of both, and unions of all
_RELATION = """k AS (SELECT DISTINCT CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE props ->> '$.k' IS NOT NULL),
t AS (SELECT k, ['null', 'boolean', 'number', 'string', 'binary'][k % 5 + 1] AS kind, CASE WHEN k % 3 <> 0 THEN 's' || k % 2 END AS sem, CASE WHEN k % 4 <> 0 THEN 'm' || k % 2 END AS media,
 CASE WHEN k % 2 = 0 THEN k % 3 ELSE 0 END AS least, CASE WHEN k % 5 <> 0 THEN k % 7 + 2 END AS most, CASE WHEN k % 2 = 0 THEN 's' || k % 3 END AS osem, k % 3 = 1 AS open, k % 4 = 1 AS has_q, 'q' || k % 8 AS q FROM k),
ss AS (SELECT a.k AS a, b.k AS b, a.kind = b.kind AND CASE WHEN a.kind IN ('string', 'binary') THEN b.sem IS NULL OR coalesce(a.sem = b.sem, false) ELSE true END
 AND CASE WHEN a.kind = 'binary' THEN b.media IS NULL OR coalesce(a.media = b.media, false) ELSE true END AS fits FROM t a, t b),
aa AS (SELECT a.k AS a, b.k AS b, s.fits AND a.least >= b.least AND (b.most IS NULL OR coalesce(a.most <= b.most, false)) AS fits FROM t a, t b, ss s WHERE s.a = a.k AND s.b = b.k),
oo AS (SELECT a.k AS a, b.k AS b, (b.osem IS NULL OR coalesce(a.osem = b.osem, false)) AND s.fits AND x.fits AND (b.open OR NOT a.open)
 AND CASE WHEN b.has_q THEN CASE WHEN a.has_q AND a.q = b.q THEN s.fits ELSE b.k % 16 <> 1 END ELSE true END AND (b.open OR NOT a.has_q OR (b.has_q AND a.q = b.q)) AS fits
 FROM t a, t b, ss s, aa x WHERE s.a = a.k AND s.b = b.k AND x.a = a.k AND x.b = b.k),
plain AS (SELECT 'S' || a AS source, 'S' || b AS target, fits FROM ss UNION ALL SELECT 'A' || a, 'A' || b, fits FROM aa UNION ALL SELECT 'O' || a, 'O' || b, fits FROM oo),
names AS (SELECT l || k AS id, l, k FROM k, (VALUES ('S'), ('A'), ('O')) v(l)),
simple AS (SELECT a.id AS source, b.id AS target, coalesce(p.fits, false) AS fits FROM names a CROSS JOIN names b LEFT JOIN plain p ON p.source = a.id AND p.target = b.id),
variants AS (SELECT DISTINCT 'U' || k AS id, v AS part FROM (SELECT k, unnest(['S' || k, 'A' || k, 'O' || k, 'S' || (k * 7 % 100)]) AS v FROM k) WHERE v IN (SELECT id FROM names)),
into_union AS (SELECT s.source, v.id AS target, bool_or(s.fits) AS fits FROM simple s JOIN variants v ON v.part = s.target GROUP BY 1, 2),
out_of_union AS (SELECT v.id AS source, s.target, bool_and(s.fits) AS fits FROM simple s JOIN variants v ON v.part = s.source GROUP BY 1, 2),
between AS (SELECT v.id AS source, w.id AS target, bool_or(o.fits) AS fits FROM (SELECT DISTINCT id FROM variants) v JOIN out_of_union o ON o.source = v.id JOIN variants w ON w.part = o.target GROUP BY 1, 2),
all_types AS (SELECT id FROM names UNION SELECT id FROM variants),
relation AS (SELECT * FROM simple UNION ALL SELECT * FROM into_union UNION ALL SELECT * FROM out_of_union UNION ALL SELECT * FROM between
 UNION ALL SELECT id, 'any', true FROM all_types UNION ALL SELECT 'any', id, false FROM all_types UNION ALL SELECT 'any', 'any', true)"""


@query(f"WITH {_RELATION} SELECT source, target, fits FROM relation")
def types_assignable(spark, sf_dir):
    known, parts = types(spark, sf_dir)
    # the relation itself is wanted, of a catalogue's types
    wanted = known.select(F.col("id").alias("source")).join(known.select(F.col("id").alias("target")), how="cross")
    return type_relation.assignable(known, parts, wanted)


_LINKS = """typed AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'S' || (props ->> '$.k') WHEN 'error' THEN 'A' || (props ->> '$.k') WHEN 'purchase' THEN 'O' || (props ->> '$.k')
 WHEN 'signup' THEN 'U' || (props ->> '$.k') ELSE 'any' END AS type FROM events),
links AS (SELECT event_id, type, lead(event_id) OVER w AS next_id, lead(type) OVER w AS next_type FROM typed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"WITH {_RELATION}, {_LINKS} SELECT event_id, next_id, fits FROM links JOIN relation ON source = type AND target = next_type")
def links_assignable(spark, sf_dir):
    """Whether what each event gives fits what the user's next event takes; each pair of types is settled once."""
    known, parts = types(spark, sf_dir)
    k = F.get_json_object("props", "$.k")
    letter = lambda name: F.concat(F.lit(name), k)
    kind = F.col("event_type")
    type_of = F.when(kind == "click", letter("S")).when(kind == "error", letter("A")).when(kind == "purchase", letter("O")).when(kind == "signup", letter("U")).otherwise("any")
    typed = lifts.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", type_of.alias("source"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    links = typed.withColumns({"next_id": F.lead("event_id").over(order), "target": F.lead("source").over(order)})
    links = links.where("source IS NOT NULL AND target IS NOT NULL")
    found = type_relation.assignable(known, parts, links)
    return links.join(found, type_relation.PAIR).select("event_id", "next_id", "fits")
