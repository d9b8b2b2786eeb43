"""DuckDB SQL for the sales path, written straight from the rules (not from the Spark plan).

For each CDM field a layout either maps it (value from the joined tables), or not (NULL, a
derived measure, or the tenant id for ``customer_id``). Bad rows are the three planted rules.
"""

from __future__ import annotations

from .. import model

AS_OF_SQL = "TIMESTAMP '2026-01-01 00:00:00'"


def _layouts_mapping(field: str) -> list[int]:
    return [i for i in range(len(model.LAYOUTS)) if field in model.layout_fields(i)]


def _in(layouts: list[int]) -> str:
    return "layout IN (" + ", ".join(str(i) for i in layouts) + ")" if layouts else "FALSE"


def _case(expr: str, *sets: list[int]) -> str:
    lay = sorted({i for s in sets for i in s})
    return f"CASE WHEN {_in(lay)} THEN {expr} END"


def _tenant_case() -> str:
    parts = " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _, _) in enumerate(model.LAYOUTS))
    return f"CASE layout {parts} END"


def _system_case() -> str:
    parts = " ".join(f"WHEN {i} THEN '{s}'" for i, (_, s, _) in enumerate(model.LAYOUTS))
    return f"CASE layout {parts} END"


JOINED = """
  SELECT l.*, o.o_custkey, o.o_orderpriority, c.c_name, p.p_partkey AS pk, p.p_name, p.p_type,
         r.r_name,
         CAST(l.l_orderkey % 6 AS INTEGER) AS layout,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS rev,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2))
              AS DECIMAL(18,2)) AS disc,
         CAST(l.l_quantity AS BIGINT) AS qty,
         CAST(CAST(l.l_quantity AS BIGINT) * CAST(p.p_retailprice AS DECIMAL(12,2))
              AS DECIMAL(18,2)) AS cst,
         (l.l_linenumber = 7 AND l.l_suppkey % 10 = 0) AS bad_rev,
         (l.l_linenumber = 6 AND l.l_suppkey % 10 = 0) AS bad_sku,
         (l.l_linenumber = 5 AND l.l_suppkey % 10 = 0 AND l.l_orderkey % 6 = 3) AS bad_date
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def checked_select() -> str:
    """Every sales row with its typed CDM values, before the required-field filter."""
    m = _layouts_mapping
    return f"""
  SELECT concat('U', layout, '_', year(l_shipdate)) AS upload_id,
         {_tenant_case()} AS customer_id,
         CAST(l_shipdate AS DATE) AS sale_date,
         CASE WHEN {_in(m('customer_id'))} THEN concat('ACC_', o_custkey)
              ELSE {_tenant_case()} END AS customer_id_val,
         {_case('c_name', m('customer_name'))} AS customer_name,
         CASE WHEN bad_sku THEN NULL ELSE {_case("concat('SKU-', pk)", m('product_sku'))} END
              AS product_sku,
         {_case('p_name', m('product_name'))} AS product_name,
         {_case('p_type', m('product_category'))} AS product_category,
         {_case('o_orderpriority', m('channel'))} AS channel,
         {_case('r_name', m('region'))} AS region,
         {_case('qty', m('units_sold'))} AS units_sold,
         CASE WHEN bad_rev THEN NULL ELSE {_case('rev', m('revenue'))} END AS revenue,
         {_case('disc', m('discount'))} AS discount,
         {_case('CAST(rev - disc AS DECIMAL(18,2))', m('net_revenue'),
                [i for i in m('revenue') if i in m('discount')])} AS net_revenue,
         {_case('cst', m('cost'))} AS cost,
         {_case('CAST(rev - cst AS DECIMAL(18,2))', m('margin'),
                [i for i in m('revenue') if i in m('cost')])} AS margin,
         {_case("concat('STORE_', l_suppkey)", m('store_id'))} AS store_id,
         {_case("concat('REP_', l_suppkey)", m('rep_id'))} AS rep_id,
         {_system_case()} AS source_system,
         {AS_OF_SQL} AS ingested_at,
         bad_rev, bad_sku, bad_date,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM ({JOINED}) j
"""


SALES_COLS = ", ".join(model.SALES_COLUMNS)


def sales_sql() -> str:
    """Accepted conformed rows."""
    return f"SELECT {SALES_COLS} FROM ({checked_select()}) x WHERE NOT bad_rev AND NOT bad_sku AND NOT bad_date"


def totals_sql(*by: str) -> str:
    keys = ", ".join(["customer_id", *by])
    d = "DECIMAL(38,2)"
    return f"""
SELECT {keys}, count(*) AS n_rows, CAST(sum(units_sold) AS BIGINT) AS units_sold,
       CAST(sum(revenue) AS {d}) AS revenue, CAST(sum(discount) AS {d}) AS discount,
       CAST(sum(net_revenue) AS {d}) AS net_revenue, CAST(sum(cost) AS {d}) AS cost,
       CAST(sum(margin) AS {d}) AS margin
FROM ({sales_sql()}) s
GROUP BY {keys}
"""


def load_report_sql() -> str:
    """Per upload counts of read, loaded, missing-required and cast-error rows."""
    return f"""
SELECT upload_id, customer_id, count(*) AS rows_read,
       count(*) FILTER (WHERE NOT bad_rev AND NOT bad_sku AND NOT bad_date) AS rows_loaded,
       count(*) FILTER (WHERE bad_sku OR bad_rev) AS rows_missing_required,
       count(*) FILTER (WHERE bad_date) AS rows_cast_error,
       CAST(0 AS BIGINT) AS rows_bad_transformation
FROM ({checked_select()}) x
GROUP BY upload_id, customer_id
"""


def load_accounting_sql(without: int) -> str:
    """Rows in the file = loaded + rejected per upload, when layout ``without`` has no mapping."""
    return f"""
SELECT upload_id, count(*) AS rows_in_file,
       count(*) FILTER (WHERE NOT none AND NOT bad_rev AND NOT bad_sku AND NOT bad_date) AS rows_loaded,
       count(*) FILTER (WHERE none OR bad_rev OR bad_sku OR bad_date) AS rows_rejected,
       count(*) FILTER (WHERE none) AS rows_without_mapping, TRUE AS balanced
FROM (SELECT *, starts_with(upload_id, 'U{without}_') AS none FROM ({checked_select()}) x) y
GROUP BY upload_id
"""


def transformed_sql() -> str:
    """The rows of layouts 0 and 1 under the transformations of ``plans.sales.TRANSFORMED``; the
    layouts after them are rejected (an unsupported text, a field claimed twice, a bad pattern) or
    lose rows to a cast of revenue to a whole number."""
    cols = ", ".join(c for c in model.SALES_COLUMNS if c not in (
        "revenue", "discount", "net_revenue", "margin", "units_sold", "product_name", "channel", "cost"))
    return f"""
WITH x AS (SELECT *, CAST(substr(upload_id, 2, 1) AS INTEGER) AS lay FROM ({checked_select()}) c
           WHERE NOT bad_rev AND NOT bad_sku AND NOT bad_date),
v AS (SELECT * REPLACE (
        CASE lay WHEN 0 THEN CAST(revenue * 0.01 AS DECIMAL(18,2)) WHEN 1 THEN CAST(round(revenue, 1) AS DECIMAL(18,2))
                 ELSE revenue END AS revenue,
        CASE lay WHEN 0 THEN CAST(discount * 2.5 AS DECIMAL(18,2)) ELSE discount END AS discount,
        CASE WHEN lay = 0 THEN units_sold * 3 ELSE units_sold END AS units_sold,
        CASE lay WHEN 0 THEN upper(product_name) WHEN 1 THEN trim(product_name) ELSE product_name END AS product_name,
        CASE WHEN lay = 0 THEN lower(channel) ELSE channel END AS channel,
        CASE WHEN lay IN (0, 1) THEN CAST(NULL AS DECIMAL(18,2)) ELSE net_revenue END AS net_revenue)
      FROM x WHERE lay IN (0, 1) OR (lay = 5 AND revenue = floor(revenue)))
SELECT {cols}, revenue, discount, coalesce(net_revenue, CAST(revenue - discount AS DECIMAL(18,2))) AS net_revenue,
       cost, CASE WHEN lay = 0 THEN CAST(revenue - cost AS DECIMAL(18,2)) ELSE margin END AS margin,
       units_sold, product_name, channel
FROM v
"""


def approved_load_sql(approved: str, entries: str) -> str:
    """Rows loaded under the latest approval of each layout: its last column is loaded only if that
    approval maps it."""
    last = {i: model.layout_fields(i)[-1] for i in range(len(model.LAYOUTS))}
    names = " ".join(f"WHEN {i} THEN sha256('{' '.join(model.layout_names(i))}')" for i in last)
    gone = {f: "lay IN (" + ", ".join(str(i) for i, g in last.items() if g == f) + ")" for f in set(last.values())}
    pick = ", ".join(f"CASE WHEN {gone[f]} AND NOT has_last THEN NULL ELSE {f} END AS {f}" for f in sorted(gone))
    cols = ", ".join(f"x.{c}" for c in model.SALES_COLUMNS if c not in gone)
    fields = " ".join(f"WHEN {i} THEN '{f}'" for i, f in last.items())
    return f"""
WITH a AS ({approved}),
top AS (SELECT sha256(array_to_string(json_keys(source_schema), ' ')) AS layout_id,
               arg_max(mapping_id, (approved_at, mapping_id)) AS mapping_id FROM a GROUP BY 1),
e AS ({entries}),
lay AS (SELECT l.lay, CASE l.lay {names} END AS layout_id, CASE l.lay {fields} END AS last_field
        FROM (SELECT unnest(range({len(last)})) AS lay) l),
has AS (SELECT lay.lay, count(e.cdm_field) > 0 AS has_last
        FROM lay JOIN top USING (layout_id) LEFT JOIN e ON e.mapping_id = top.mapping_id AND e.cdm_field = lay.last_field
        GROUP BY lay.lay)
SELECT {cols}, {pick}
FROM (SELECT *, CAST(substr(upload_id, 2, 1) AS INTEGER) AS lay FROM ({checked_select()}) c) x JOIN has USING (lay)
WHERE NOT bad_rev AND NOT bad_sku AND NOT bad_date
"""


def _text_values() -> dict[str, str]:
    """DuckDB text rendering of each CDM field, as the raw file would carry it."""
    return {
        "date": "CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || CASE WHEN bad_date THEN ' or so' ELSE '' END",
        "customer_id": "concat('ACC_', o_custkey)",
        "customer_name": "c_name",
        "product_sku": "CASE WHEN bad_sku THEN '' ELSE concat('SKU-', pk) END",
        "product_name": "p_name",
        "product_category": "p_type",
        "channel": "o_orderpriority",
        "region": "r_name",
        "units_sold": "CAST(qty AS VARCHAR)",
        "revenue": "CASE WHEN bad_rev THEN 'n/a' ELSE CAST(rev AS VARCHAR) END",
        "discount": "CAST(disc AS VARCHAR)",
        "net_revenue": "CAST(CAST(rev - disc AS DECIMAL(18,2)) AS VARCHAR)",
        "cost": "CAST(cst AS VARCHAR)",
        "margin": "CAST(CAST(rev - cst AS DECIMAL(18,2)) AS VARCHAR)",
        "store_id": "concat('STORE_', l_suppkey)",
        "rep_id": "concat('REP_', l_suppkey)",
    }


ORDER_COLS = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
              "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")


def _list_case(items_per_layout: list[list[str]]) -> str:
    parts = " ".join(f"WHEN {i} THEN [{', '.join(items)}]"
                     for i, items in enumerate(items_per_layout))
    return f"CASE layout {parts} END"


def names_case() -> str:
    return _list_case([[f"'{n}'" for n in model.layout_names(i)]
                       for i in range(len(model.LAYOUTS))])


def raw_rows_sql() -> str:
    """(upload_id, layout, names, vals, order columns) for every sales row."""
    tv = _text_values()
    vals = _list_case([[tv[f] for f in model.layout_fields(i)]
                       for i in range(len(model.LAYOUTS))])
    return f"""
  SELECT concat('U', layout, '_', year(l_shipdate)) AS upload_id, layout,
         {names_case()} AS names, {vals} AS vals, {ORDER_COLS}
  FROM ({JOINED}) j
"""
