"""Views that give general tables the shape of the civic schema, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavel.functions.text import SEVERAL, SINGLE, SPACES

#: Where the dialects differ: (Spark, DuckDB).
DIALECT = {
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "COLLAPSE": (r"btrim(regexp_replace({0}, '[ \\t\\r\\n\\f\\x0B]+', ' '), '" + SPACES + "')", r"trim(regexp_replace({0}, '[ \t\r\n\f\x0B]+', ' ', 'g'))"),
    "LINES": ("(SELECT doc_id, pos AS line_no, col AS line FROM (SELECT doc_id, posexplode(split(text, '\\n')) FROM {0}))", "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {0}))"),
    "UPPER": (f"array_join(transform(split({{0}}, ''), x -> if(contains('{SEVERAL}', x), translate(x, '{SEVERAL}', '{SINGLE}'), upper(x))), '')", "upper({0})"),
    "ARRAY": ("array({0}, {1})", "[{0}, {1}]"),
}

VIEWS = {
    "place": "SELECT n_nationkey + 1 AS id, lower(n_name) AS name, r_name AS state, concat('ocd-division/country:us/state:ca/place:', lower(n_name)) AS ocd_division_id FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "organization": "SELECT dense_rank() OVER (ORDER BY c_nationkey, c_mktsegment) AS id, c_nationkey + 1 AS place_id, c_mktsegment AS name FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}) k",
    "event": "SELECT o_orderkey + 1 AS id, CAST(o_orderdate AS DATE) AS record_date, o_orderpriority AS name, concat(o_orderstatus, ' ', o_orderpriority) AS meeting_type, p.name AS source, p.ocd_division_id, p.id AS place_id, g.id AS organization_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {place} p ON p.id = c_nationkey + 1 LEFT JOIN {organization} g ON g.place_id = p.id AND g.name = c_mktsegment",
    "document": "SELECT l_orderkey * 1000000 + l_partkey + 1 AS id, l_orderkey + 1 AS event_id, l_partkey + 1 AS catalog_id, CASE min(l_returnflag) WHEN 'A' THEN 'agenda' WHEN 'N' THEN 'minutes' ELSE 'agenda_html' END AS category FROM {lineitem} GROUP BY l_orderkey, l_partkey",
    "catalog": "SELECT id, content, content_hash, CASE WHEN id % 3 <> 0 THEN substring(content, 1, 200) END AS summary, CASE WHEN id % 5 <> 0 THEN content_hash ELSE 'stale' END AS summary_source_hash, CASE WHEN id % 7 = 0 THEN 'empty' WHEN id % 2 = 0 THEN 'complete' END AS agenda_segmentation_status, brand, part_type, topics FROM (SELECT p_partkey + 1 AS id, text AS content, CASE WHEN COLLAPSE(text) <> '' THEN SHA(COLLAPSE(text)) END AS content_hash, p_brand AS brand, p_type AS part_type, ARRAY(p_brand, p_type) AS topics FROM {part} LEFT JOIN {documents} ON p_partkey = doc_id) c",
    "agenda_item": "SELECT doc_id * 1000000000 + line_no AS id, doc_id + 1 AS catalog_id, line_no AS item_order, line AS title, CAST(1 + floor(line_no / 10) AS BIGINT) AS page_number FROM LINES({documents}) l",
    "span": "SELECT event_id, ts, event_type AS phase, value AS duration_s, user_id AS catalog_id FROM {events}",
    "event_stage": "SELECT o.o_orderkey * 2 + k AS id, CASE WHEN o.o_orderkey % 30 = 0 THEN 'unknown' ELSE p.ocd_division_id END AS ocd_division_id, CASE WHEN o.o_orderkey % 70 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS record_date, concat(o.o_orderpriority, CASE WHEN o.o_orderkey % 3 = 0 THEN ' new' ELSE '' END) AS name FROM {orders} o JOIN {customer} ON o_custkey = c_custkey JOIN {place} p ON p.id = c_nationkey + 1 JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) twice ON k = 0 OR o.o_orderkey % 2 = 0",
    "ab_row": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm, quality AS section_compliance_pass, toxic AS fallback_used, CAST((doc_id * 37) % 1000 AS DOUBLE) AS duration_ms, (doc_id * 13) % 500 AS total_tokens FROM {labels}",
    "person": "SELECT s_suppkey + 1 AS id, lower(s_name) AS name, concat('client', CAST(s_nationkey AS VARCHAR(10))) AS client, s_nationkey + 1 AS place_id FROM {supplier}",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _macro(sql: str, which: int) -> str:
    """Replace NAME(args) of DIALECT, innermost last."""
    for name, forms in DIALECT.items():
        while (at := sql.find(f"{name}(")) >= 0:
            depth, i = 0, at + len(name)
            for i in range(at + len(name), len(sql)):
                depth += (sql[i] == "(") - (sql[i] == ")")
                if not depth:
                    break
            inner = sql[at + len(name) + 1 : i]
            args = [x.strip() for x in inner.split(",")] if name == "ARRAY" else [inner]
            form = forms[which]
            for k, a in enumerate(args):
                form = form.replace("{" + str(k) + "}", a)
            sql = sql[:at] + form + sql[i + 1 :]
    return sql


class Tables:
    """Base tables and civic views of a directory, each a DataFrame: t.orders, t.event."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            found = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        elif name in VIEWS:
            sql = _macro(VIEWS[name], 0)
            used = {n: getattr(self, n) for n in (*BASE, *VIEWS) if "{" + n + "}" in sql}
            found = self._spark.sql(sql, **used)
        else:
            raise AttributeError(name)
        setattr(self, name, found)
        return found


def from_sql(t: Tables, sql: str) -> DataFrame:
    """A DataFrame by SQL that both engines share; names of tables in braces are views or base tables."""
    sql = _macro(sql, 0)
    return t._spark.sql(sql, **{n: getattr(t, n) for n in (*BASE, *VIEWS) if "{" + n + "}" in sql})


def twin(body: str) -> str:
    """DuckDB SQL: the views that body needs, then body. Names of tables in braces are views or base tables."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for n in VIEWS:
            if "{" + n + "}" in sql and n not in needed:
                visit(VIEWS[n])
                needed.append(n)

    visit(body)
    parts = [f"{n} AS ({_macro(VIEWS[n], 1)})" for n in needed]
    body = _macro(body, 1).strip()
    opening = next((o for o in ("WITH RECURSIVE ", "WITH ") if body.startswith(o)), "")
    if opening:
        parts.append(body[len(opening) :])
        text = opening + ",\n".join(parts)
    else:
        text = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
    for n in (*BASE, *VIEWS):
        text = text.replace("{" + n + "}", n)
    return text
