"""Queries on workflow graphs, manifests, statuses and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.timecodes import downscale_factor, edit_point
from ..functions.vectors import tidy
from ..operators import workflow, workflow_files, workflow_templates
from . import lifts
from .lifts import r
from .registry import query


def _workflows(spark, sf_dir):
    """(workflow, json): a chain of two to four nodes an event, of types that follow the event; every fourth lacks its last
    node, every fifth repeats a link, every seventh has an input that no link feeds."""
    i = F.col("event_id")
    e = lifts.table(spark, sf_dir, "events").withColumn("n", (2 + i % 3).cast("int"))
    s = lambda c: c.cast("string")
    kind = lambda k: F.element_at(F.array(*map(F.lit, ("image", "LATENT", " bool ", "MODEL_PATCH"))), ((i + k) % 4 + 1).cast("int"))

    def node(k):
        feed = F.when((i % 7 == 0) & (k == F.col("n")), F.lit("9")).otherwise(s(k - 1))
        ins = F.when(k > 1, F.concat(F.lit('{"name":"i","type":"'), kind(k - 1), F.lit('","link":'), feed, F.lit("}"))).otherwise("")
        outs = F.when(k < F.col("n"), F.concat(F.lit('{"name":"o","type":"'), kind(k), F.lit('","links":['), s(k), F.lit("]}"))).otherwise("")
        mark = F.when(k % 2 == 0, '"').otherwise("")
        return F.concat(F.lit('{"id":'), mark, s(k), mark, F.lit(',"type":"'), F.col("event_type"), F.lit('","inputs":['), ins, F.lit('],"outputs":['), outs, F.lit("]}"))

    def link(k):
        return F.concat(F.lit("["), s(k), F.lit(","), s(k), F.lit(",0,"), s(k + 1), F.lit(',0,"'), kind(k), F.lit('"]'))

    last = F.when(i % 4 == 0, F.col("n") - 1).otherwise(F.col("n"))
    nodes = F.array_join(F.transform(F.sequence(F.lit(1), last), node), ",")
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n") - 1), link), ",")
    links = F.when(i % 5 == 0, F.concat(link(F.lit(1)), F.lit(","), links)).otherwise(links)
    return e.select(i.cast("long").alias("workflow"), F.concat(F.lit('{"nodes":['), nodes, F.lit('],"links":['), links, F.lit('],"extra":{"k":1}}')).alias("json"))


#: the same texts, taken apart with JSON functions
_W = """e AS (SELECT CAST(event_id AS BIGINT) AS i, CAST(2 + event_id % 3 AS INTEGER) AS n, event_type FROM events), kinds AS (SELECT ['image', 'LATENT', ' bool ', 'MODEL_PATCH'] AS kinds),
 ns AS (SELECT i, string_agg('{"id":' || CASE WHEN k % 2 = 0 THEN '"' || k || '"' ELSE k::VARCHAR END || ',"type":"' || event_type || '","inputs":[' || CASE WHEN k > 1 THEN '{"name":"i","type":"' || kinds[(i + k - 1) % 4 + 1] || '","link":' || CASE WHEN i % 7 = 0 AND k = n THEN 9 ELSE k - 1 END || '}' ELSE '' END
  || '],"outputs":[' || CASE WHEN k < n THEN '{"name":"o","type":"' || kinds[(i + k) % 4 + 1] || '","links":[' || k || ']}' ELSE '' END || ']}', ',' ORDER BY k) AS nodes FROM e, kinds, range(1, 5) t(k) WHERE k <= n - CASE WHEN i % 4 = 0 THEN 1 ELSE 0 END GROUP BY 1),
 ls AS (SELECT i, string_agg('[' || k || ',' || k || ',0,' || (k + 1) || ',0,"' || kinds[(i + k) % 4 + 1] || '"]', ',' ORDER BY k, c) AS links FROM e, kinds, range(1, 5) t(k), range(2) u(c) WHERE k < n AND (c = 0 OR (k = 1 AND i % 5 = 0)) GROUP BY 1),
 w AS (SELECT i AS workflow, CAST('{"nodes":[' || nodes || '],"links":[' || links || '],"extra":{"k":1}}' AS JSON) AS json FROM ns JOIN ls USING (i)),
 n AS (SELECT workflow, x->>'id' AS id, CAST(x->'inputs' AS JSON[]) AS ins, CAST(x->'outputs' AS JSON[]) AS outs FROM (SELECT workflow, unnest(CAST(json->'nodes' AS JSON[])) AS x FROM w)),
 l AS (SELECT workflow, CAST(x->>0 AS BIGINT) AS id, x->>1 AS origin, x->>3 AS target, x->>5 AS type FROM (SELECT workflow, unnest(CAST(json->'links' AS JSON[])) AS x FROM w)),
 i AS (SELECT workflow, id, x->>'type' AS type, CAST(x->>'link' AS BIGINT) AS link FROM (SELECT workflow, id, unnest(ins) AS x FROM n)),
 o AS (SELECT workflow, id, x->>'type' AS type, unnest(CAST(x->'links' AS BIGINT[])) AS link FROM (SELECT workflow, id, unnest(outs) AS x FROM n))"""
_SOCKET = "CASE upper(trim(type)) WHEN 'BOOL' THEN 'BOOLEAN' WHEN 'MODEL_PATCH' THEN 'MODEL' ELSE upper(trim(type)) END"


@query(f"""WITH {_W} SELECT workflow, 'repeated_link' AS problem, CAST(id AS VARCHAR) AS ref FROM l GROUP BY 1, 3 HAVING count(*) > 1
 UNION ALL SELECT DISTINCT l.workflow, 'link_without_node', CAST(l.id AS VARCHAR) FROM l WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.workflow = l.workflow AND n.id = l.origin) OR NOT EXISTS (SELECT 1 FROM n WHERE n.workflow = l.workflow AND n.id = l.target)
 UNION ALL SELECT DISTINCT workflow, 'input_without_link', i.id FROM i WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.workflow = i.workflow AND l.id = i.link)
 UNION ALL SELECT DISTINCT workflow, 'output_without_link', o.id FROM o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.workflow = o.workflow AND l.id = o.link)""")
def workflow_validate(spark, sf_dir):
    return workflow.problems(_workflows(spark, sf_dir))


@query(f"WITH {_W} SELECT workflow, id, origin, target, type FROM l")
def workflow_links(spark, sf_dir):
    return workflow.links(_workflows(spark, sf_dir)).select("workflow", "id", "origin", "target", "type")


@query(f"""WITH {_W}, a AS (SELECT workflow, 'i' AS k, {_SOCKET} AS t FROM i UNION SELECT workflow, 'o', {_SOCKET} FROM o UNION SELECT workflow, 'l', {_SOCKET} FROM l)
 SELECT workflow, coalesce(string_agg(t, ',' ORDER BY t) FILTER (k = 'i'), '') AS inputs, coalesce(string_agg(t, ',' ORDER BY t) FILTER (k = 'o'), '') AS outputs, coalesce(string_agg(t, ',' ORDER BY t) FILTER (k = 'l'), '') AS links FROM a GROUP BY 1""")
def observed_socket_types(spark, sf_dir):
    out = workflow.socket_types(_workflows(spark, sf_dir))
    return out.select("workflow", *(F.concat_ws(",", c).alias(c) for c in ("inputs", "outputs", "links")))


_PROMPT = """p AS (SELECT event_id AS prompt, CAST('{"1":{"class_type":"Load","inputs":{"name":"a.png","size":[1,2,3]}},"' || (2 + event_id % 4) || '":{"class_type":"' || event_type || '","inputs":{"images":["1",' || (event_id % 3) || '],"mask":' || CASE WHEN event_id % 2 = 0 THEN '["' || (event_id % 9) || '",1]' ELSE '["x",-1]' END || '}}}' AS JSON) AS json FROM events),
 n AS (SELECT prompt, unnest(json_keys(json)) AS node, json FROM p), b AS (SELECT prompt, node, json_extract(json, '$."' || node || '".inputs') AS ins FROM n), v AS (SELECT prompt, node, unnest(json_keys(ins)) AS input, ins FROM b),
 x AS (SELECT prompt, node, input, json_extract(ins, '$."' || input || '"') AS raw FROM v)"""


@query(f"WITH {_PROMPT} SELECT CAST(prompt AS BIGINT) AS prompt, node, input, raw->>0 AS origin, CAST(raw->>1 AS INTEGER) AS slot FROM x WHERE json_type(raw) = 'ARRAY' AND json_array_length(raw) = 2 AND CAST(raw->>1 AS INTEGER) >= 0")
def prompt_links(spark, sf_dir):
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    mask = F.when(i % 2 == 0, F.concat(F.lit('["'), s(i % 9), F.lit('",1]'))).otherwise('["x",-1]')
    json = F.concat(F.lit('{"1":{"class_type":"Load","inputs":{"name":"a.png","size":[1,2,3]}},"'), s(2 + i % 4), F.lit('":{"class_type":"'), F.col("event_type"), F.lit('","inputs":{"images":["1",'), s(i % 3), F.lit('],"mask":'), mask, F.lit("}}}"))
    return workflow.prompt_links(lifts.table(spark, sf_dir, "events").select(i.alias("prompt"), json.alias("json")))


def _items(spark, sf_dir):
    d = lifts.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    day = F.concat(F.lit("2024-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"))
    return d.select(
        i.alias("pos"), F.concat(F.lit(" Item "), (i % 37).cast("string"), F.lit("!! ")).alias("item_id"), F.when(i % 11 != 0, F.concat(F.lit(" The "), "source", F.lit(" Clip "))).alias("title"),
        F.when(i % 7 != 0, i).alias("playlist_index"), F.when(i % 5 != 0, F.col("n_chars").cast("double")).alias("duration_seconds"), F.when(i % 9 != 0, day).alias("upload_date"),
    )


_I = """items AS (SELECT doc_id AS pos, ' Item ' || (doc_id % 37) || '!! ' AS item_id, CASE WHEN doc_id % 11 <> 0 THEN ' The ' || source || ' Clip ' END AS title, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS playlist_index,
 CASE WHEN doc_id % 5 <> 0 THEN CAST(n_chars AS DOUBLE) END AS duration_seconds, CASE WHEN doc_id % 9 <> 0 THEN '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS upload_date FROM documents)"""


@query(f"""WITH {_I} SELECT pos FROM items WHERE contains(coalesce(lower(trim(title)), ''), 'clip') AND NOT contains(coalesce(lower(trim(title)), ''), 'src3') AND coalesce(playlist_index, 0) >= 5 AND playlist_index <= 900
 AND duration_seconds >= 300 AND duration_seconds <= 4000 AND replace(upload_date, '-', '') BETWEEN '20240201' AND '20241130'""")
def manifest_filter(spark, sf_dir):
    return workflow.manifest_filter(_items(spark, sf_dir), " CLIP ", ("src3", " "), 5, 900, 300, 4000, "2024-02-01", "2024/11/30").select("pos")


@query(f"WITH {_I} SELECT pos, CASE WHEN k > 0 THEN id || '-' || k ELSE id END AS item_id FROM (SELECT pos, id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS k FROM (SELECT pos, 'Item-' || (pos % 37) AS id FROM items))")
def manifest_unique_ids(spark, sf_dir):
    return workflow.with_unique_ids(_items(spark, sf_dir)).select("pos", "item_id")


@query(f"""WITH {_I}, s AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'filtered' WHEN pos % 3 = 0 THEN 'skipped' WHEN pos % 5 = 0 THEN 'download_failed' WHEN pos % 7 = 0 THEN 'rejected' WHEN pos % 11 = 0 THEN 'analysis_failed' ELSE 'analysed' END AS status FROM items)
 SELECT count(*) AS total, count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'download_failed') AS download_failed, count(*) FILTER (status = 'rejected') AS rejected,
 count(*) FILTER (status = 'analysis_failed') AS analysis_failed, count(*) FILTER (status = 'analysed') AS analysed, sum(duration_seconds) AS duration FROM s""")
def collection_summary(spark, sf_dir):
    p = F.col("pos")
    flags = {"matched": p % 2 != 0, "existing": p % 3 == 0, "downloaded": p % 5 != 0, "accepted": p % 7 != 0, "analysed": p % 11 != 0}
    rows = _items(spark, sf_dir).withColumns(flags)
    return workflow.rolled_up(rows.withColumn("status", workflow.status(rows)))


@query("SELECT event_type AS kind, count(*) AS records FROM events GROUP BY 1")
def dataset_summary(spark, sf_dir):
    return lifts.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("records"))


@query("""WITH t AS (SELECT page_id, url, CAST(page_id AS DOUBLE) / 8 - 3 AS v FROM pages)
 SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS frame_number, regexp_replace(regexp_replace(printf('%.3f', v), '\\.?0+$', ''), '^-0$', '0') AS short_number,
 replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS escaped, CASE WHEN regexp_full_match(url, '[A-Za-z0-9_./:=+-]+') THEN url ELSE '''' || url || '''' END AS quoted FROM t""".replace("'\\\\.?0+$'", "'\\.?0+$'"))
def text_functions(spark, sf_dir):
    p = lifts.table(spark, sf_dir, "pages")
    return p.select("page_id", tx.frame_number(F.col("url")).alias("frame_number"), tx.short_number(F.col("page_id").cast("double") / 8 - 3).alias("short_number"), tx.escape_xml(F.col("url")).alias("escaped"), tx.shell_quote(F.col("url")).alias("quoted"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'collection' ELSE 'a-' || event_id END AS item, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '20240115' END AS date, CASE WHEN event_id % 2 = 0 THEN 'https://x.org/' || event_id ELSE 'https://v.org/w?v=' || event_id END AS url,
 CASE event_id % 3 WHEN 0 THEN 'BOOLEAN' WHEN 1 THEN 'MODEL' ELSE 'LATENT' END AS socket, CASE event_id % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.3048 ELSE NULL END AS metres, 'a+b%2Ac~' || event_id AS escaped FROM events""")
def identifier_functions(spark, sf_dir):
    e = lifts.table(spark, sf_dir, "events")
    i = F.col("event_id")
    s = i.cast("string")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % 3 + 1).cast("int"))
    return e.select(
        "event_id", tx.item_id(F.when(i % 4 == 0, "!!--").otherwise(F.concat(F.lit("--a !--"), s, F.lit("?")))).alias("item"), tx.upload_date(F.when(i % 3 == 0, "2024-1-5").otherwise("2024/01/15")).alias("date"),
        tx.source_url(F.when(i % 2 == 0, F.concat(F.lit("https://x.org/"), s)).otherwise("ftp://no"), fallback=F.concat(F.lit("https://v.org/w?v="), s)).alias("url"),
        tx.socket_type(pick(" bool ", "model_patch", "latent")).alias("socket"), tx.metres_per_unit(pick("centimeter", "foot", "furlong")).alias("metres"), tx.query_escape(F.concat(F.lit("a b*c~"), s)).alias("escaped"),
    )


@query("SELECT event_id, CASE WHEN event_id % 8 = 0 AND event_id > 0 THEN event_id // 8 END AS latent_w, CASE WHEN event_id % 8 = 0 AND event_id > 0 THEN CAST(8 AS BIGINT) END AS latent_h, round(CASE WHEN event_id < 256 THEN 1.0 ELSE event_id / 256.0 END, 6) + 0.0 AS factor, event_id % 7 = 0 OR (event_id % 256 >= 96 AND event_id % 256 >= 1.35 * 80) AS red FROM events")
def image_functions(spark, sf_dir):
    e = lifts.table(spark, sf_dir, "events")
    i = F.col("event_id")
    w, h = workflow.latent_size(i, F.lit(64))
    red = tx.is_red((i % 256), F.lit(80), F.lit(80), F.when(i % 7 == 0, "RED"))
    return e.select("event_id", w.alias("latent_w"), h.alias("latent_h"), tidy(downscale_factor(i)).alias("factor"), red.alias("red"))


@query("SELECT CAST(event_id % 64 // 8 AS BIGINT) AS ly, CAST(user_id % 64 // 8 AS BIGINT) AS lx, greatest(max(value - 200), 0.0) AS value FROM events GROUP BY 1, 2")
def latent_mask(spark, sf_dir):
    e = lifts.table(spark, sf_dir, "events")
    return workflow.latent_mask(e.select((F.col("event_id") % 64).alias("y"), (F.col("user_id") % 64).alias("x"), (F.col("value") - 200).alias("value")))


@query("SELECT event_id, lpad(CAST(event_id // 90000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id // 1500 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id // 25 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 25 AS VARCHAR), 2, '0') AS edit FROM events")
def edit_points(spark, sf_dir):
    e = lifts.table(spark, sf_dir, "events")
    return e.select("event_id", edit_point(F.col("event_id"), F.lit(25.0)).alias("edit"))


@query("""WITH w AS (SELECT event_id AS workflow, CAST('{"nodes":[{"id":1,"type":"CheckpointLoaderSimple","widgets_values":["' || event_type || '.ckpt",7]},{"id":2,"type":"' || CASE WHEN event_id % 2 = 0 THEN 'LoadImage' ELSE 'SaveImage' END || '","widgets_values":["in' || user_id || '.png"," ","12"]},{"id":3,"type":"KSampler","widgets_values":["euler"]}],"links":[]}' AS JSON) AS json FROM events),
 n AS (SELECT workflow, x->>'type' AS type, unnest(CAST(x->'widgets_values' AS JSON[])) AS v FROM (SELECT workflow, unnest(CAST(json->'nodes' AS JSON[])) AS x FROM w)),
 k AS (SELECT CAST(workflow AS BIGINT) AS workflow, CASE type WHEN 'CheckpointLoaderSimple' THEN 'model' WHEN 'LoadImage' THEN 'image' WHEN 'SaveImage' THEN 'output' END AS kind, v->>'$' AS value FROM n)
 SELECT DISTINCT workflow, kind, value FROM k WHERE kind IS NOT NULL AND trim(value) <> '' AND TRY_CAST(value AS DOUBLE) IS NULL""")
def workflow_assets(spark, sf_dir):
    kind = F.when(F.col("event_id") % 2 == 0, "LoadImage").otherwise("SaveImage")
    json = F.concat(F.lit('{"nodes":[{"id":1,"type":"CheckpointLoaderSimple","widgets_values":["'), F.col("event_type"), F.lit('.ckpt",7]},{"id":2,"type":"'), kind, F.lit('","widgets_values":["in'), F.col("user_id").cast("string"), F.lit('.png"," ","12"]},{"id":3,"type":"KSampler","widgets_values":["euler"]}],"links":[]}'))
    return workflow.assets(lifts.table(spark, sf_dir, "events").select(F.col("event_id").alias("workflow"), json.alias("json")))


@query("SELECT page_id FROM pages WHERE page_id * 10 BETWEEN 100 AND 2000 AND page_id % 3 <> 2")
def local_file_filter(spark, sf_dir):
    i = F.col("page_id")
    ending = F.element_at(F.array(*map(F.lit, (".MP4", ".webm", ".txt"))), (i % 3 + 1).cast("int"))
    rows = lifts.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/v/clip"), i.cast("string"), ending).alias("path"), (i * 10).alias("length"))
    return workflow.file_filter(rows, 100, 2000, ("mp4", ".WEBM")).select("page_id")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND event_id % 5 <> 0 AND (event_id % 7 = 0 OR (event_id % 256 >= 96 AND event_id % 256 >= 1.35 * 100))")
def red_observations(spark, sf_dir):
    """Observations of wanted kinds that have a region and are red, as said or by their colour."""
    e = lifts.table(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = e.select("event_id", F.col("event_type").alias("label"), F.when(i % 5 != 0, i).alias("region"), (i % 256).alias("r"), F.when(i % 7 == 0, "Red").alias("colour"))
    red = tx.is_red(F.col("r"), F.lit(100), F.lit(60), F.col("colour"))
    return rows.where(F.col("label").isin("click", "view") & F.col("region").isNotNull() & red).select("event_id")


#: modes and their nodes, wires and widgets, as counted by hand
_MODES = "(VALUES (0, 'text_to_image', 7, 9, 13), (1, 'image_to_image', 8, 11, 11), (2, 'inpaint', 9, 12, 12), (3, 'upscale', 4, 3, 3), (4, 'flux_inpaint', 11, 12, 17)) m(k, mode, nodes, links, widgets)"


def _requests(spark, sf_dir):
    """A request for each document, of one mode after the other; some lack what their mode needs."""
    d, i = lifts.table(spark, sf_dir, "documents"), F.col("doc_id")
    modes = F.array(*(F.lit(m) for m in ("text_to_image", "image_to_image", "inpaint", "upscale", "flux_inpaint")))
    return d.select(
        i.alias("workflow"), F.element_at(modes, (i % 5 + 1).cast("int")).alias("mode"), "text", F.coalesce(F.col("text"), F.lit("")).alias("prompt"), F.concat(F.lit('no "'), F.coalesce("lang", F.lit("none")), F.lit('"')).alias("negative_prompt"),
        (512 + 64 * (i % 3)).alias("width"), F.when(i % 41 == 0, 0).otherwise(512).alias("height"), (20 + i % 7).alias("steps"), (i % 9 * 0.5 + 1).cast("double").alias("cfg_scale"), F.lit("euler").alias("sampler_name"), F.lit("normal").alias("scheduler"), i.alias("seed"),
        F.concat(F.lit("base-"), F.coalesce("source", F.lit("none")), F.lit(".safetensors")).alias("checkpoint"), F.lit("4x.pth").alias("upscale_model"), F.when(i % 11 != 3, F.concat(F.lit("in"), i.cast("string"), F.lit(".png"))).alias("input_image"),
        F.when(i % 13 != 5, F.lit("mask.png")).alias("mask_image"), (i % 4 * 0.25).cast("double").alias("denoise"), F.lit("out").alias("output_prefix"),
    )


@query(f"""SELECT doc_id AS workflow, coalesce(reason, 'ok') AS reason, CASE WHEN reason IS NULL THEN nodes END AS nodes, CASE WHEN reason IS NULL THEN links END AS links, CASE WHEN reason IS NULL THEN widgets END AS widgets,
 CASE WHEN reason IS NULL THEN nodes END AS last_node, CASE WHEN reason IS NULL AND mode <> 'upscale' THEN CASE WHEN mode = 'text_to_image' THEN '1.0' ELSE CAST(CAST(doc_id % 4 * 0.25 AS DOUBLE) AS VARCHAR) END END AS denoise,
 CASE WHEN reason IS NULL AND mode <> 'upscale' THEN md5(coalesce(text, '')) END AS prompt, CASE WHEN reason IS NULL THEN 0 END AS problems
 FROM (SELECT *, CASE WHEN doc_id % 41 = 0 THEN 'width and height must be positive' WHEN mode IN ('image_to_image', 'upscale') AND doc_id % 11 = 3 THEN 'input_image is needed'
  WHEN mode IN ('inpaint', 'flux_inpaint') AND (doc_id % 11 = 3 OR doc_id % 13 = 5) THEN 'input_image and mask_image are needed' END AS reason FROM documents JOIN {_MODES} ON m.k = doc_id % 5)""")
def generation_workflows(spark, sf_dir):
    """Workflows of all modes, written as JSON, taken apart and validated: what they hold, and why requests are rejected."""
    boxes, wires, rejected = workflow_templates.generated(_requests(spark, sf_dir))
    own = boxes.groupBy("workflow").agg(
        F.count("*").alias("nodes"), F.sum(F.size("widgets_values")).alias("widgets"), F.max("id").alias("last_node"), F.max(F.when(F.col("type") == "KSampler", F.element_at("widgets_values", 6))).alias("denoise"),
        F.min(F.when(F.col("type") == "CLIPTextEncode", F.struct("id", F.md5(F.element_at(F.from_json(F.concat(F.lit("["), F.element_at("widgets_values", 1), F.lit("]")), "array<string>"), 1)).alias("p")))).alias("prompt"),
    )
    files = workflow.as_json(boxes.withColumn("outputs", F.transform("outputs", lambda o: F.struct(o["name"], o["type"], o["links"]))), wires)
    wrong = workflow.problems(files).groupBy("workflow").agg(F.count("*").alias("problems"))
    good = own.join(wires.groupBy("workflow").agg(F.count("*").alias("links")), "workflow").join(wrong, "workflow", "left")
    good = good.select("workflow", F.lit("ok").alias("reason"), "nodes", "links", "widgets", "last_node", "denoise", F.col("prompt.p").alias("prompt"), F.coalesce("problems", F.lit(0).cast("long")).alias("problems"))
    return good.unionByName(rejected, allowMissingColumns=True)


_FILE = """'{"version":0.4,"mood":{"deep":[1,{"x":null}]},"nodes":[{"id":1,"type":"Load","pos":[1.5,2],"outputs":[{"name":"IMAGE","type":"IMAGE[]","links":[7],"tint":"#f00"}],"flags":{"k":' || (props ->> '$.k') || '}},'
 || '{"id":"two","type":"Save","inputs":[{"name":"images","type":"IMAGE[]","link":7,"shape":3}],"widgets_values":["' || event_type || '",[1,"[a]"],true]}],"links":[[7,1,0,"two",0,"IMAGE[]","more"]],"last_link_id":' || event_id || '}'"""


@query(f"""WITH w AS (SELECT event_id AS workflow, {_FILE} AS j FROM events) SELECT workflow, true AS same, j ->> '$.mood.deep[0]' AS deep, j ->> '$.nodes[0].flags.k' AS flag, j ->> '$.nodes[0].outputs[0].tint' AS tint, j ->> '$.nodes[1].inputs[0].shape' AS shape,
 j ->> '$.nodes[1].widgets_values[1][1]' AS widget, j ->> '$.links[0][5]' AS type, j ->> '$.links[0][6]' AS more, 'two' AS target FROM w""")
def workflow_round_trip(spark, sf_dir):
    """Files with unknown fields at all levels, taken apart and put together again: equal as JSON, and what they hold."""
    e = lifts.table(spark, sf_dir, "events")
    e = e.withColumn("k", F.get_json_object("props", "$.k"))
    sql = _FILE.replace("(props ->> '$.k')", "k").replace("\n", " ")
    files = e.select(F.col("event_id").alias("workflow"), F.expr(sql).alias("json"))
    documents, boxes, wires = workflow_files.taken_apart(files)
    back = workflow_files.put_together(documents, boxes, wires).withColumnRenamed("json", "again")
    plain = lambda c: F.to_json(F.parse_json(c))
    at = lambda path: F.get_json_object("again", path)
    out = files.join(back, "workflow").join(wires.select("workflow", "target"), "workflow")
    return out.select("workflow", (plain("json") == plain("again")).alias("same"), at("$.mood.deep[0]").alias("deep"), at("$.nodes[0].flags.k").alias("flag"), at("$.nodes[0].outputs[0].tint").alias("tint"), at("$.nodes[1].inputs[0].shape").alias("shape"),
        at("$.nodes[1].widgets_values[1][1]").alias("widget"), at("$.links[0][5]").alias("type"), at("$.links[0][6]").alias("more"), "target")
