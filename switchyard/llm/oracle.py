"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from switchyard.llm.queries import LISTED_HOSTS
from switchyard.llm.urls import RULES, TRACKING

_GAP = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_GAP}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t),
k AS (SELECT doc_id, i, w,
             string_agg(w, ' ') OVER nxt AS win, count(*) OVER nxt AS n
      FROM w WINDOW nxt AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
d AS (SELECT doc_id, i, w, CASE WHEN n = 20 AND row_number() OVER (PARTITION BY win, n ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS late FROM k),
c AS (SELECT doc_id, i, w, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM d),
s AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM t LEFT JOIN s ON t.doc_id = s.doc_id"""


def _op9() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r.name), r.name))

    def case(value):
        fits = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'" for r in rules)
        return f"CASE {fits} END"

    return rf"""
WITH p AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace('&' || coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''),
                   '&({"|".join(TRACKING)})=[^&]*', '', 'g'), '^&+', '') AS query
  FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
                || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key,
             {case("name")} AS rule, {case("verdict")} AS fixed FROM p),
listed AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '{LISTED_HOSTS}') AND key IS NOT NULL)
SELECT page_id, host, path, rule,
       coalesce(fixed, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN fixed IS NULL THEN l.key IS NOT NULL END AS listed
FROM k LEFT JOIN listed l ON k.key = l.key"""


#: crc32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda v, k: xor(v // 2, (v % 2) * 3988292384))), 4294967295)"""

OP11 = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
                  md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS first_id, {_CRC} % 9 AS h FROM c),
r AS (SELECT h.conv_id, t.i, t.d, t.n FROM h JOIN t ON t.conv_id = h.first_id AND t.i <= h.h
      UNION ALL SELECT h.conv_id, t.i, t.d, t.n FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
q AS (SELECT conv_id, n, row_number() OVER o AS depth, string_agg(d, '') OVER (o ROWS UNBOUNDED PRECEDING) AS path FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
m AS (SELECT conv_id, depth, path, n FROM q UNION ALL SELECT conv_id, 0, '', 0 FROM c),
v AS (SELECT path, any_value(depth) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM m GROUP BY path),
k AS (SELECT v.*, p.conv_id AS parent_conv_id, p.path AS parent FROM v LEFT JOIN v p ON v.depth > 0 AND p.path = left(v.path, length(v.path) - 32)),
w AS (SELECT k.*, (SELECT count(*) FROM k x WHERE x.parent = k.path) AS n_children FROM k),
s AS (SELECT a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.n) AS saved
      FROM (SELECT path AS below, unnest(list_transform(range(0, depth + 1), lambda j: left(path, 32 * j))) AS path FROM w) a JOIN w b ON b.path = a.below GROUP BY a.path),
l AS (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY conv_id),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM l GROUP BY path)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, w.parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN s ON s.path = w.path LEFT JOIN e ON e.path = w.path"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3, "op9_url_filter": _op9(), "op11_prefix_trie": OP11}
