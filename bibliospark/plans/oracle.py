"""DuckDB SQL for the correctness oracle.

The same bibliographic mapping as ``bibliospark.sources.star``, written as CTEs
over the landed tables, so every oracle query is self-contained ANSI-ish SQL.
"""

from __future__ import annotations

from ..functions.text import PY_WHITESPACE_CODEPOINTS

# Python str.strip() in DuckDB: trim() with the explicit character set.
_WS_SQL = " || ".join(f"chr({cp})" for cp in PY_WHITESPACE_CODEPOINTS)


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {_WS_SQL})"


def sql_year_of(expr: str) -> str:
    head = f"substr({expr}, 1, 4)"
    return f"(CASE WHEN regexp_full_match({head}, '[0-9]{{1,4}}') THEN CAST({head} AS INTEGER) END)"


VIEWS = {
    "articles": """
  SELECT o.o_orderkey AS id,
         CAST(o.o_orderkey AS VARCHAR) AS scopus_id,
         'Article ' || CAST(o.o_orderkey AS VARCHAR) AS titre,
         d.text AS resume,
         strftime(o.o_orderdate, '%Y-%m-%d') AS date_publication,
         o.o_orderpriority AS revue,
         CASE WHEN o.o_orderstatus = 'F' THEN '10.5555/' || CAST(o.o_orderkey AS VARCHAR) ELSE '' END AS doi,
         d.text AS mots_cles,
         d.source AS domaine_recherche
  FROM orders o LEFT JOIN documents d ON d.doc_id = o.o_orderkey""",
    "authors": """
  SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS scopus_author_id,
         p_name AS nom_complet, p_brand AS orcid
  FROM part""",
    "article_author": """
  SELECT l_orderkey AS article_id, l_partkey AS auteur_id FROM lineitem""",
    "affiliations": """
  SELECT s.s_suppkey AS id, s.s_name AS nom_institution, n.n_name AS pays,
         CAST(s.s_suppkey AS VARCHAR) AS scopus_affiliation_id
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "author_affiliation": """
  SELECT l_partkey AS auteur_id, l_suppkey AS affiliation_id FROM lineitem""",
    "messages": """
  SELECT event_id AS id, user_id, event_type AS question, props AS response, ts AS created_at
  FROM events""",
    "vectors": """
  SELECT e.vec_id AS article_id, e.embedding, a.date_publication
  FROM embeddings e LEFT JOIN articles a ON e.vec_id = a.id""",
    "query_vectors": """
  SELECT vec_id AS qid, embedding FROM embeddings""",
}

# CTE dependencies between the views above.
_DEPS = {"vectors": ["articles"]}


def with_views(body: str, *names: str) -> str:
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in ordered)
    if not ordered:
        return body
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        # the body brings its own CTEs: append them after the views
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
