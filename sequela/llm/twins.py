"""SQL twins of the queries over training text that SQL can express."""

from __future__ import annotations

#: Unsigned CRC-32 of a text of ASCII characters, bit by bit (4294967295: all ones, 3988292384: the reflected polynomial).
_CRC32 = """
xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda y, nothing: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))))
"""

_TRIE = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS body
    FROM conversations WHERE conv_id IS NOT NULL),
digested AS (
    SELECT *, md5(length(role) || ':' || role || body) AS digest FROM turns),
convs AS (
    SELECT conv_id, list({{'digest': digest, 'chars': length(body)}} ORDER BY turn NULLS FIRST, role, digest) AS own
    FROM digested GROUP BY conv_id),
cut AS (
    SELECT conv_id, own, conv_id - conv_id % 100 AS head, {_CRC32.format(text="conv_id::VARCHAR")} % 6 AS h FROM convs),
rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS path
    FROM cut a LEFT JOIN convs b ON b.conv_id = a.head),
prefixes AS (
    SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt),
nodes AS (
    SELECT path[1:d] AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d), '') AS ends
    FROM prefixes GROUP BY 1, 2),
parents AS (
    SELECT a.*, b.conv_id AS parent_conv_id, b.node AS parent
    FROM nodes a LEFT JOIN nodes b ON b.depth = a.depth - 1 AND b.node = a.node[1:a.depth - 1]),
children AS (
    SELECT parent AS node, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY 1),
counted AS (
    SELECT p.*, coalesce(c.n_children, 0) AS n_children,
           CASE WHEN p.depth > 0 THEN (p.n_convs - 1) * p.node[p.depth].chars ELSE 0 END AS own_saved
    FROM parents p LEFT JOIN children c ON c.node = p.node),
above AS (
    SELECT node, n_children, own_saved, unnest(range(0, depth + 1)) AS d FROM counted),
subtrees AS (
    SELECT node[1:d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved) AS saved FROM above GROUP BY 1)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN subtrees s ON s.node = c.node
"""

_COLLOCATIONS = r"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents),
pieces AS (
    SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
listed AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed WHERE len(w) > 0),
spans AS (
    SELECT lang, w, i, unnest([1, 2, 3, 4]) AS m FROM places),
counts AS (
    SELECT lang, w[i:i + m - 1] AS words, m, count(*) AS f
    FROM spans WHERE i + m - 1 <= len(w) GROUP BY 1, 2, 3),
sizes AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY 1),
candidates AS (
    SELECT * FROM counts WHERE m > 1 AND f >= 30),
cuts AS (
    SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (
    SELECT c.lang, c.words, c.m, c.f AS a, c.k, x.f AS l, y.f AS r,
           ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
    FROM cuts c
    JOIN counts x ON x.lang = c.lang AND x.words = c.words[1:c.k]
    JOIN counts y ON y.lang = c.lang AND y.words = c.words[c.k + 1:]),
best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
starts AS (
    SELECT lang, words, m, f, unnest(range(1, m + 1)) AS i FROM candidates WHERE m > 2),
shorter AS (
    SELECT lang, words, m, f, i, unnest([2, 3]) AS size FROM starts),
inside AS (
    SELECT lang, words[i:i + size - 1] AS words, max(f) AS most
    FROM shorter WHERE size < m AND i + size - 1 <= m GROUP BY 1, 2),
kept AS (
    SELECT b.* FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.words = b.words
    WHERE s.most IS NULL OR 100::HUGEINT * s.most < 80::HUGEINT * b.a),
ranked AS (
    SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
    FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op12_prefix_trie": _TRIE, "op13_collocations": _COLLOCATIONS}
