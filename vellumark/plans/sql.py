"""DuckDB SQL of the sequential walks, written independently of the kernels: recursive queries over positions."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _walk(source: str, limit: int, boundary: bool, lookback: float, overlap: int, snap: bool) -> str:
    """WITH RECURSIVE cur(doc_id, text, k, s, e): the k-th window of each text beyond the limit."""
    keep = int(limit * lookback)

    def cut(s: str) -> str:
        window = f"substring(text, ({s}) + {keep + 2}, {limit - 2 - keep})"
        at = f"strpos(reverse(translate({window}, '。.!！?？', '......')), '.')"
        end = f"CASE WHEN {at} > 0 THEN ({s}) + {limit} - {at} ELSE ({s}) + {limit} END" if boundary else f"({s}) + {limit}"
        return f"CASE WHEN ({s}) + {limit} >= length(text) THEN length(text) ELSE {end} END"

    begin = "e"
    if overlap:
        raw = f"(e - {overlap})"
        if snap:
            ahead = f"substring(text, {raw} + 1, {overlap - 1})"
            line, stop = f"strpos({ahead}, chr(10))", f"strpos(translate({ahead}, '。.!！?？', '......'), '.')"
            raw = f"(CASE WHEN {line} > 0 THEN {raw} + {line} WHEN {stop} > 0 THEN {raw} + {stop} ELSE {raw} END)"
        begin = f"CASE WHEN e - {overlap} > s THEN greatest({raw}, s + 1) ELSE e END"
    return f"""src AS ({source}),
cur AS (
  SELECT doc_id, text, 0 AS k, 0::BIGINT AS s, ({cut("0")})::BIGINT AS e FROM src WHERE length(text) > {limit}
  UNION ALL SELECT doc_id, text, k + 1, b, ({cut("b")})::BIGINT FROM (SELECT doc_id, text, k, ({begin})::BIGINT AS b FROM cur WHERE e < length(text)))"""


def budget(limit: int, boundary: bool = True, lookback: float = 0.5, overlap: int = 0, snap: bool = False, merge: int = 0, source: str = "SELECT doc_id, text FROM documents") -> str:
    pieces = "SELECT doc_id, k, substring(text, s + 1, e - s) AS content FROM cur"
    if merge:
        marked = f"SELECT doc_id, k, content, sum(CASE WHEN k = 0 OR length(content) >= {merge} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM ({pieces})"
        pieces = f"SELECT doc_id, g AS k, string_agg(content, '' ORDER BY k) AS content FROM ({marked}) GROUP BY doc_id, g"
    return f"""WITH RECURSIVE {_walk(source, limit, boundary, lookback, overlap, snap)}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS para_idx, content FROM ({pieces}) WHERE regexp_matches(content, '\\S')
UNION ALL SELECT doc_id, 0, text FROM src WHERE length(text) <= {limit}"""


def chunk_overlap(turns: str, size: int, overlap: int) -> str:
    keyed = f"SELECT doc_id * 100000 + para_idx AS doc_id, content AS text FROM ({turns})"
    stripped = f"SELECT doc_id, para_idx, trim(content, {_BLANK}) AS content FROM ({budget(size, overlap=overlap, snap=True, source=keyed)})"
    return f"""SELECT b.doc_id // 100000 AS doc_id, (b.doc_id % 100000)::INT AS para_idx, t.title, (row_number() OVER (PARTITION BY b.doc_id ORDER BY b.para_idx) - 1)::INT AS chunk_idx, b.content
FROM ({stripped}) b JOIN ({turns}) t ON b.doc_id = t.doc_id * 100000 + t.para_idx WHERE b.content <> ''"""


def mark(source: str, size: int = 256) -> str:
    pattern = f"'(?s).{{1,{size}}}[。| \\\\.！;；!\\n]'"
    trimmed = lambda x: f"trim({x}, {_BLANK})"
    cut = f"list_transform(range(0, length({trimmed('p')}), {size}), lambda i: {trimmed(f'substring({trimmed("p")}, i::INT + 1, {size})')})"
    rest = f"flatten(list_transform(regexp_split_to_array(text, {pattern}), lambda p: CASE WHEN length({trimmed('p')}) < {size} THEN [{trimmed('p')}] ELSE {cut} END))"
    parts = f"list_filter(list_concat(list_transform(regexp_extract_all(text, {pattern}), lambda m: {trimmed('m')}), {rest}), lambda x: x <> '')"
    return f"SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INT AS para_idx, unnest(parts) AS content FROM (SELECT doc_id, {parts} AS parts FROM ({source}))"


def paragraph_overlap(turns: str, overlap: int) -> str:
    return f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS n FROM ({turns})),
f AS (
  SELECT doc_id, para_idx, n, title, content FROM t WHERE n = 1
  UNION ALL SELECT t.doc_id, t.para_idx, t.n, t.title, CASE WHEN t.content <> '' AND regexp_matches(right(f.content, {overlap}), '\\S') THEN right(f.content, {overlap}) || ' ' || t.content ELSE t.content END
  FROM f JOIN t ON t.doc_id = f.doc_id AND t.n = f.n + 1)
SELECT doc_id, para_idx, title, content FROM f"""


def pack(rows: str, header: str, limit: int) -> str:
    head = header.replace("\n", "' || chr(10) || '")
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o) AS n FROM ({rows})),
f AS (
  SELECT key, n, line, 0 AS p, {len(header)} + length(line) AS size FROM r WHERE n = 1
  UNION ALL SELECT r.key, r.n, r.line, CASE WHEN f.size + length(r.line) < {limit} THEN f.p ELSE f.p + 1 END, CASE WHEN f.size + length(r.line) < {limit} THEN f.size ELSE {len(header)} END + length(r.line)
  FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT key, p::INT AS para_idx, '{head}' || string_agg(line, '' ORDER BY n) AS content FROM f GROUP BY key, p"""


def token_recall(limit: int) -> str:
    words = r"unnest(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'))"
    return f"""WITH p AS ({budget(limit)}), a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, {words.format("text")} AS w FROM documents) GROUP BY ALL),
b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, {words.format("content")} AS w FROM p) GROUP BY ALL)
SELECT doc_id, sum(coalesce(a.n, 0))::BIGINT AS n_tokens, sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::BIGINT AS n_kept, sum(coalesce(b.n, 0))::BIGINT AS n_out FROM a FULL JOIN b USING (doc_id, w) GROUP BY doc_id"""
