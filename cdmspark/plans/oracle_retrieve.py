"""DuckDB brute-force oracles for the neighbour queries."""

from __future__ import annotations

from .oracle_workflow import approved_sql
from .oracle_sales import raw_rows_sql


def sround(x: str, d: int) -> str:
    """Round like Spark does for a double: half up on its shortest decimal text."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def _name_words(n: str) -> str:
    s = f"regexp_replace({n}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    s = f"lower(regexp_replace({s}, '[^A-Za-z0-9]+', ' ', 'g'))"
    return f"list_filter(string_split(trim({s}), ' '), lambda w: w <> '')"


def _grams(words: str) -> str:
    g = ("list_transform(range(1, greatest(len('#' || w || '#') - 2, 1) + 1), "
         "lambda i: substr('#' || w || '#', i, 3))")
    return f"list_distinct(flatten(list_transform({words}, lambda w: {g})))"


def schema_tokens(src: str, id_expr: str, names_expr: str) -> str:
    words = f"flatten(list_transform({names_expr}, lambda n: {_name_words('n')}))"
    return f"SELECT {id_expr} AS id, unnest({_grams(words)}) AS term FROM ({src}) s"


def prose_tokens(src: str, id_expr: str, text_expr: str) -> str:
    toks = (f"list_filter(regexp_split_to_array(lower({text_expr}), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda w: w <> '')")
    return f"SELECT {id_expr} AS id, unnest({toks}) AS term FROM ({src}) s"


def topk_tfidf(corpus_tokens: str, query_tokens: str, k: int = 3) -> str:
    return f"""
WITH ctf AS (SELECT id, term, count(*) AS tf FROM ({corpus_tokens}) c GROUP BY id, term),
qtf AS (SELECT id, term, count(*) AS tf FROM ({query_tokens}) q GROUP BY id, term),
nd AS (SELECT count(DISTINCT id) AS n FROM ctf),
dfs AS (SELECT term, count(*) AS df FROM ctf GROUP BY term),
idf AS (SELECT term, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM dfs, nd),
cw0 AS (SELECT c.id, c.term, c.tf * i.idf AS w0 FROM ctf c JOIN idf i USING (term)),
cw AS (SELECT id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY id)) AS w FROM cw0),
qw0 AS (SELECT q.id, q.term, q.tf * coalesce(i.idf, ln(nd.n + 1.0) + 1) AS w0
        FROM qtf q LEFT JOIN idf i USING (term), nd),
qw AS (SELECT id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY id)) AS w FROM qw0),
s AS (SELECT q.id AS query_id, c.id AS doc_id, sum(q.w * c.w) AS score
      FROM qw q JOIN cw c USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id
                                   ORDER BY {sround('score', 9)} DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, {sround(sround('score', 9), 6)} AS score, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= {k}
"""


def documents_sql() -> str:
    return topk_tfidf(prose_tokens("SELECT * FROM documents", "doc_id", "text"),
                      prose_tokens("SELECT * FROM benchmark", "item_id", "text"))


def schema_queries_sql() -> str:
    return f"SELECT DISTINCT upload_id, names FROM ({raw_rows_sql()}) r"


def schemas_sql() -> str:
    return topk_tfidf(schema_tokens(approved_sql(), "mapping_id", "json_keys(source_schema)"),
                      schema_tokens(schema_queries_sql(), "upload_id", "names"))


def schema_neighbours_sql() -> str:
    return f"""
SELECT t.query_id, t.rank, t.score, a.mapping_id, a.customer_id, a.source_schema, a.cdm_mapping
FROM ({schemas_sql()}) t JOIN ({approved_sql()}) a ON a.mapping_id = t.doc_id
"""


def neighbour_ids_sql() -> str:
    return f"""
SELECT query_id, list(doc_id ORDER BY rank) AS similar_ids,
       to_json(list(doc_id ORDER BY rank)) AS similar_mapping_ids,
       CAST(count(*) AS INTEGER) AS similar_mappings_used
FROM ({schemas_sql()}) t GROUP BY query_id
"""


def vectors_sql(k: int = 3) -> str:
    return f"""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_reduce(list_transform(e, lambda y: y * y),
                                                                  lambda a, b: a + b)))
             AS u FROM v),
p AS (SELECT a.id AS query_id, b.id AS doc_id,
             list_reduce(list_transform(list_zip(a.u, b.u), lambda t: t[1] * t[2]),
                         lambda x, y: x + y) AS score
      FROM u a, u b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id
                                   ORDER BY {sround('score', 9)} DESC, doc_id) AS rank FROM p)
SELECT query_id, doc_id, {sround(sround('score', 9), 6)} AS score, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= {k}
"""
