"""DuckDB statements of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""

SQL["op1_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, row_number() OVER o - 1 AS no, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tok,
    length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '[', '\o'), chr(10), '\n'))
      + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '[', '\o')) + 8 + 1 + 7 AS chars
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
q AS (SELECT *, tok > 384 AS big, coalesce(sum(tok) OVER b, 0) AS pre,
        coalesce(sum(CASE WHEN tok > 384 THEN 1 ELSE 0 END) OVER b, 0) AS bigs
      FROM p WINDOW b AS (PARTITION BY conv_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, struct_pack(a := bigs, b := big, c := CASE WHEN NOT big THEN floor(pre / 384) ELSE -1 END) AS cell FROM q),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY no) - 1 AS span FROM (
        SELECT *, no = 0 OR cell IS DISTINCT FROM lag(cell) OVER (PARTITION BY conv_id ORDER BY no) AS opens FROM k)),
o AS (SELECT conv_id, span, pre FROM s WHERE opens),
rep AS (SELECT s.conv_id, sum(s.chars) AS chars FROM s JOIN o ON s.conv_id = o.conv_id AND o.span > s.span
        AND (CASE WHEN s.no = 0 AND s.role = 'system' THEN TRUE ELSE o.pre - s.pre <= 256 END) GROUP BY 1),
c AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY no) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM s GROUP BY 1)
SELECT c.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(c.chars + coalesce(rep.chars, 0) AS BIGINT) AS formatted_chars
FROM c LEFT JOIN rep ON c.conv_id = rep.conv_id
"""

SQL["op9_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(list_slice(w, p, p + 19), ' ') ORDER BY doc_id, p) AS rn FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM k WHERE rn > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
j AS (SELECT words.doc_id, words.i, word, gone.i IS NOT NULL AS g FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE g) AS n_removed,
        coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT g), '') AS kept FROM j GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN a ON documents.doc_id = a.doc_id
"""

SQL["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS x FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
         ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""


def _models(order: int = 5) -> str:
    """Interpolated probabilities of both classes, one common table expression per context length."""
    levels = []
    for size in range(1, order + 2):
        below = "1.0::DOUBLE / 256" if size == 1 else "b.p_{c}"
        shares = ", ".join(
            f"CASE WHEN all_{c} > 0 THEN ({c} + types_{c} * {below.format(c=c)}) / (all_{c} + types_{c}) ELSE {below.format(c=c)} END AS p_{c}"
            for c in "ar")
        source = f"(SELECT * FROM e WHERE size = {size}) v"
        joined = "" if size == 1 else f" JOIN m{size - 1} b ON b.event = right(v.event, {size - 1})"
        levels.append(f"m{size} AS (SELECT v.event, {shares} FROM {source}{joined})")
    return ",\n".join(levels)


SQL["op12_url_filter"] = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) AS path FROM u),
k AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(rh, rp, rv)),
d AS (SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS ruled
      FROM h LEFT JOIN k ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
-- page_id is the key of the test tables; repeated rows would need a row number here
t AS (SELECT *, host || path AS text, CAST('0x' || md5(CAST(page_id AS VARCHAR))[1:8] AS BIGINT) % 5 AS fold FROM d),
p AS (SELECT text, unnest(range(1, length(text) + 2)) AS i, CASE WHEN fold <> 0 AND ruled = 'allow' THEN 1 ELSE 0 END AS a,
        CASE WHEN fold <> 0 AND ruled = 'block' THEN 1 ELSE 0 END AS r FROM t),
g AS (SELECT substring('     ' || text || ' ', i, 6) AS gram, sum(a) AS a, sum(r) AS r FROM p GROUP BY 1),
e0 AS (SELECT size, right(gram, CAST(size AS INTEGER)) AS event, sum(a) AS a, sum(r) AS r FROM g, (SELECT unnest(range(1, 7)) AS size) GROUP BY ALL),
e AS (SELECT *, sum(a) OVER w AS all_a, sum(r) OVER w AS all_r, count(*) FILTER (WHERE a > 0) OVER w AS types_a,
        count(*) FILTER (WHERE r > 0) OVER w AS types_r FROM e0 WINDOW w AS (PARTITION BY size, left(event, CAST(size - 1 AS INTEGER)))),
{_models()},
llr AS (SELECT event AS gram, CAST(round((ln(p_a) - ln(p_r)) * 1000000) AS BIGINT) AS ratio FROM m6),
q AS (SELECT DISTINCT text FROM t),
s AS (SELECT text, sum(ratio) AS total, count(*) AS places
      FROM (SELECT text, substring('     ' || text || ' ', i, 6) AS gram FROM (SELECT text, unnest(range(1, length(text) + 2)) AS i FROM q)) x
      JOIN llr USING (gram) GROUP BY text),
f AS (SELECT t.*, floor(CAST(total AS DOUBLE) / places / 15625.0) AS bin, CAST(floor(CAST(total AS DOUBLE) / places) AS BIGINT) AS score_micronats
      FROM t JOIN s USING (text)),
b AS (SELECT bin, count(*) FILTER (WHERE ruled = 'allow') AS yes, count(*) FILTER (WHERE ruled = 'block') AS no
      FROM f WHERE fold = 0 AND ruled IS NOT NULL GROUP BY bin),
c AS (SELECT bin, coalesce(sum(no) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        sum(yes) OVER (ORDER BY bin DESC) AS above FROM b
      UNION ALL SELECT max(bin) + 1, sum(no), 0 FROM b),
cut AS (SELECT coalesce((SELECT bin FROM c, (SELECT sum(yes) AS good, sum(no) AS bad FROM b) WHERE good > 0 AND bad > 0
        ORDER BY above * bad + below * good DESC, abs(bin), bin LIMIT 1), 0) AS least_bin)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bin >= least_bin THEN 'allow' ELSE 'block' END) AS verdict, score_micronats FROM f, cut
"""

SQL["op11_phrase_mining"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
      FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 100),
k AS (SELECT lang, phrase, size, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.*, h.f AS l, t.f AS r, n, CAST(1000::HUGEINT * a * n // (h.f::HUGEINT * t.f) AS BIGINT) AS score
      FROM k JOIN f h ON h.lang = k.lang AND h.phrase = k.head JOIN f t ON t.lang = k.lang AND t.phrase = k.tail JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
      FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
