"""SQL that gives the same rows as the operators' queries, written independently of them, for DuckDB."""

COSINE_COMPONENTS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
   AND list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b
), least AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component_id,
       e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c ON c.node = e.vec_id
"""

WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS digest
  FROM p
), g AS (SELECT hex, max(page_id) AS response FROM d GROUP BY hex)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM d JOIN g USING (hex)
"""


def _nibble_table() -> str:
    """CRC-32 of the 16 half bytes (reflected polynomial 0xEDB88320), as a SQL list."""
    values = []
    for half in range(16):
        for _ in range(4):
            half = (half >> 1) ^ (0xEDB88320 if half & 1 else 0)
        values.append(half)
    return "list_value(" + ", ".join(f"{v}::BIGINT" for v in values) + ")"


_BYTE = "xor(c, b)"
for _ in range(2):
    _BYTE = f"xor(({_BYTE}) >> 4, list_extract({_nibble_table()}, (({_BYTE}) & 15) + 1))"


def _drawn(turn: int, half: str, below: str) -> str:
    return f"(('0x' || substr(md5('11:{turn}:' || ({half})), 1, 15))::BIGINT % {below})"


#: Row numbers by rank, then four rounds on (left, right) and a walk by recursion.
SHARDS = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: {_BYTE}), 4294967295) AS text_crc32
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, bytes) - 1 AS row_no FROM docs
), dims AS (
  SELECT n, a, CAST(ceil(n::DOUBLE / a) AS BIGINT) AS b
  FROM (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM documents)
), walk AS (
  SELECT row_no, row_no AS spot, 0 AS step FROM ranked
  UNION ALL
  SELECT row_no, l4 * b + (r2 + {_drawn(4, "l4", "b")}) % b AS spot, step + 1
  FROM (SELECT *, (l2 + {_drawn(3, "r2", "a")}) % a AS l4 FROM
    (SELECT *, (spot % b + {_drawn(2, "l2", "b")}) % b AS r2 FROM
      (SELECT *, (spot // b + {_drawn(1, "spot % b", "a")}) % a AS l2 FROM walk, dims WHERE step = 0 OR spot >= n)))
)
SELECT doc_id, (bytes + 1)::BIGINT AS size, text_crc32, 'rows' AS law, (spot % 8)::INT AS shard, (spot // 8)::BIGINT AS slot, NULL::INT AS grown_shard
FROM ranked JOIN (SELECT row_no, arg_max(spot, step) AS spot FROM walk GROUP BY row_no) USING (row_no)
"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

#: Token sets of every size counted outright, tokens of the same urls as one, subsets pruned, the best fixed rule by length.
URLS = f"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS url, {_HOST} AS host, {_PATH} AS path, row_number() OVER () AS n FROM pages
), t AS (
  SELECT DISTINCT n, unnest(list_concat(
    CASE WHEN regexp_extract(url, '(?s)^([A-Za-z0-9+.-]*)://', 1) <> '' THEN ['scheme:' || lower(regexp_extract(url, '(?s)^([A-Za-z0-9+.-]*)://', 1))] ELSE [] END,
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x),
    list_transform(list_filter(string_split_regex(lower(path), '[/.]'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'path:' || x),
    list_transform(list_filter(list_transform(string_split(regexp_extract(url, '(?s)[?]([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'query:' || x)
  )) AS tok FROM p WHERE host <> ''
), l AS (
  SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY 1
), marked AS (
  SELECT p.n, l.bad FROM p JOIN l ON l.doc_id = try_cast(nullif(regexp_extract(p.path, '/([0-9]{{1,18}})(?:[^0-9/][^/]*)?/?$', 1), '') AS BIGINT)
  WHERE l.bad IS NOT NULL AND p.host <> ''
), mt AS (
  SELECT t.n, t.tok, m.bad FROM t JOIN marked m USING (n)
), least AS (
  SELECT greatest(2, 0.002 * count(*)) AS hits, count(*)::DOUBLE AS total, sum(bad)::DOUBLE AS bad FROM marked
), lists AS (
  SELECT tok, list(n ORDER BY n) AS urls FROM mt GROUP BY tok HAVING sum(bad) >= (SELECT hits FROM least)
), groups AS (
  SELECT min(tok) AS tok, list(tok ORDER BY tok) AS grp FROM lists GROUP BY urls
), o AS (
  SELECT mt.* FROM mt SEMI JOIN groups USING (tok)
), subsets AS (
  SELECT n, bad, [tok] AS r, tok AS last FROM o
  UNION ALL SELECT s.n, s.bad, list_append(s.r, o.tok), o.tok FROM subsets s JOIN o ON s.n = o.n AND o.tok > s.last
), sets AS (
  SELECT r, sum(bad)::DOUBLE AS met, count(*)::DOUBLE AS freq FROM subsets GROUP BY r
), strong AS (
  SELECT r FROM sets, least l WHERE met >= l.hits AND met / freq >= 0.6 AND met * (total - l.bad) >= (freq - met) * (2.0 * l.bad)
   AND (met / freq + 3.8416 / (2 * freq) - 1.96 * sqrt(met / freq * (1 - met / freq) / freq + 3.8416 / (4 * freq * freq))) / (1 + 3.8416 / freq) >= l.bad / total
   AND l.bad BETWEEN 1 AND total - 1
), rules AS (
  SELECT r FROM strong s WHERE NOT EXISTS (SELECT 1 FROM strong q WHERE len(q.r) < len(s.r) AND len(list_intersect(q.r, s.r)) = len(q.r))
), whole AS (
  SELECT list_sort(flatten(list(grp))) AS w FROM (SELECT r, unnest(r) AS tok FROM rules) JOIN groups USING (tok) GROUP BY r
), met AS (
  SELECT n, min(array_to_string(w, ' ')) AS blocked_by
  FROM (SELECT n, list(tok) AS toks FROM t GROUP BY n) x, whole WHERE len(list_intersect(x.toks, w)) = len(w) GROUP BY n
), fixed AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) f(h, x, v)
), best AS (
  SELECT n, arg_max(h || x, len(h || x)) AS rule, arg_max(v, len(h || x)) AS v FROM p, fixed
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked_by IS NULL THEN 'allow' ELSE 'block' END) AS verdict, blocked_by
FROM p LEFT JOIN best USING (n) LEFT JOIN met USING (n)
"""
