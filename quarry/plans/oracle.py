"""DuckDB SQL building blocks for the catalog's results."""

from __future__ import annotations

from quarry.functions.stopwords import STOP_WORDS
from quarry.functions.text import CONTENT_TYPES, SPACE

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

DOCS = r"SELECT doc_id AS doc_ord, source AS title, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text FROM documents"
PARAGRAPHS = rf"""SELECT doc_ord, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)),
    lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+\z', '', 'g')), lambda x: x <> '') AS ps FROM d"""


def file_name(column: str) -> str:
    return f"list_extract(string_split({column}, '/'), -1)"


def extension(name: str) -> str:
    return rf"lower(regexp_extract({name}, '[^./](\.[^./]+)\z', 1))"


def content_type(name: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in CONTENT_TYPES.items())
    return f"CASE {extension(name)} {cases} ELSE 'text/plain' END"


def some_name() -> str:
    return "['A.PDF', 'x.tar.gz', '.md', 'noext', 'b.Md', 'c.docx', 'd.doc', 'e.markdown', 'f.txt.exe'][1 + page_id % 9]"


def all_tokens(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def words(column: str) -> str:
    return rf"len(regexp_extract_all({column}, '[^{SPACE}]+'))"


def corpus(last: str, ingest: bool = False) -> str:
    """Chunks, term counts, rarity and weights of the documents, then ``last``."""
    bare = rf"regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+\z', '', 'g')" if ingest else "text"
    return rf"""
        WITH RECURSIVE d AS ({DOCS}), p AS ({PARAGRAPHS}),
        r AS (
            SELECT doc_ord, ps, 1 AS i, length(ps[1]) AS n, 0 AS chunk_pos FROM p WHERE len(ps) > 0
            UNION ALL
            SELECT doc_ord, ps, i + 1, CASE WHEN n + length(ps[i + 1]) > 800 THEN 0 ELSE n END + length(ps[i + 1]),
                   chunk_pos + CASE WHEN n + length(ps[i + 1]) > 800 THEN 1 ELSE 0 END
            FROM r WHERE i < len(ps)),
        chunks AS (
            SELECT doc_ord, chunk_pos, string_agg(ps[i], chr(10) ORDER BY i) AS chunk FROM r GROUP BY doc_ord, chunk_pos
            UNION ALL SELECT doc_ord, 0, {bare} FROM p WHERE len(ps) = 0),
        corpus AS (
            SELECT doc_ord::VARCHAR AS id, title, chunk_pos, chunk, row_number() OVER (ORDER BY doc_ord, chunk_pos) - 1 AS chunk_idx
            FROM chunks JOIN d USING (doc_ord)),
        terms AS (SELECT chunk_idx, unnest({all_tokens('chunk')}) AS term FROM corpus),
        tf AS (SELECT chunk_idx, term, count(*) AS tf FROM terms WHERE term NOT IN ({STOP}) GROUP BY chunk_idx, term),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        idf AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus))::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM df),
        postings AS (
            SELECT chunk_idx, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY chunk_idx)) AS w FROM tf JOIN idf USING (term))
        {last}"""


def vectors(questions: str) -> str:
    """Weights and ranked scores of ``questions``, as further table expressions."""
    return f"""
        {questions},
        qt AS (SELECT qid, unnest({all_tokens('question')}) AS term FROM q),
        qtf AS (SELECT qid, term, count(*) AS tf FROM qt GROUP BY qid, term),
        qv AS (SELECT qid, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY qid)) AS qw FROM qtf JOIN idf USING (term)),
        scores AS (SELECT qid, chunk_idx, round(sum(w * qw), 9) AS score FROM postings JOIN qv USING (term) GROUP BY qid, chunk_idx),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx DESC) AS rank FROM scores WHERE score > 0)"""


def asked(last: str, blank: bool = False) -> str:
    text = "CASE WHEN item_id % 5 <> 0 THEN text WHEN item_id % 2 = 0 THEN ' ' ELSE 'the of and' END" if blank else "text"
    q = f"q AS (SELECT item_id AS qid, {text} AS question FROM benchmark)"
    return corpus(f", {vectors(q)}, top AS (SELECT * FROM ranked WHERE rank <= 5) {last}")


def steps(last: str) -> str:
    q = """turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS step, text FROM conversations
            WHERE role = 'user'),
        q AS (SELECT {'c': conv_id, 's': step} AS qid, text AS question FROM turns)"""
    hits = """hits AS (SELECT qid.c AS qid, qid.s AS step, rank, chunk_idx FROM ranked WHERE rank <= 3),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_idx ORDER BY step, rank) AS again FROM hits),
        once AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY step, rank) AS nth FROM firsts WHERE again = 1)"""
    return corpus(f", {vectors(q)}, {hits} {last}")


def answered(last: str, blank: bool = False) -> str:
    answers = f"""answers AS (
        SELECT q.qid, coalesce(string_agg(c.chunk, chr(10) || chr(10) ORDER BY rank), '') AS context, count(c.chunk) AS n_chunks,
               count(DISTINCT c.title) AS unique_sources, coalesce(sum({words('c.chunk')}), 0)::BIGINT AS tokens,
               least(1.0, count(c.chunk) / 5.0::DOUBLE) AS coverage,
               CASE WHEN context <> '' THEN '(No provider configured.) Context summary:' || chr(10) || context ELSE 'No documents ingested yet.' END AS answer
        FROM q LEFT JOIN top t ON t.qid = q.qid LEFT JOIN corpus c ON c.chunk_idx = t.chunk_idx GROUP BY q.qid)"""
    return asked(f", {answers} {last}", blank)
