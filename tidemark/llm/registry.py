"""The queries of this subpackage, by name."""

from __future__ import annotations

from .bestfit import op9_token_matrices
from .convtrie import op12_conversation_trie
from .dartminhash import op8_dartminhash
from .fim import op13_fim
from .fingerprint import edited_texts, op7_fingerprint
from .mixing import op4_mixing
from .packing import op2_packing
from .quality import op6_quality
from .qualityrules import op5_quality_rules, quality_rule_counts
from .sentencepieces import op11_sentencepiece
from .suffixdedup import op10_suffix_dedup
from .toxicity import op1_toxicity
from .warc import op3_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality": op6_quality,
    "op7_fingerprint": op7_fingerprint,
    "op8_dartminhash": op8_dartminhash,
    "op9_token_matrices": op9_token_matrices,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_fim": op13_fim,
    "quality_rule_counts": quality_rule_counts,
    "edited_texts": edited_texts,
}

_BITS = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))
_BASE32 = f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '')"

_CRC = "4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))"
_H = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))

#: DuckDB SQL of the queries that SQL can express. The others rest on hashes of
#: the engine, tokenizers, fitted models or orders of rows that SQL has not.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits,
  min(page_id) OVER (PARTITION BY html) AS first, row_number() OVER (PARTITION BY html ORDER BY page_id) = 1 AS response FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN NOT response THEN first END AS refers_to FROM d""",
    "op12_conversation_trie": f"""WITH s AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, k, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM s),
c AS (SELECT conv_id, conv_id - (conv_id % 5 + 5) % 5 AS p, ({_CRC}) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, k, size FROM c JOIN t ON t.conv_id = p AND pos <= h UNION ALL SELECT conv_id, pos, k, size FROM c JOIN t USING (conv_id) WHERE pos > h),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM r),
pre AS (SELECT conv_id, d, size, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT node, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM pre GROUP BY node),
kids AS (SELECT left(node, -64) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
sub AS (SELECT a.node, CAST(sum((u.n_convs - 1) * u.size) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM n AS u LEFT JOIN kids USING (node) JOIN pre AS a ON a.conv_id = u.conv_id AND a.d <= u.depth GROUP BY 1),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM pre JOIN (SELECT conv_id, max(d) AS d FROM pre GROUP BY 1) USING (conv_id, d) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
  FROM n LEFT JOIN n AS up ON n.depth > 0 AND up.node = left(n.node, -64) LEFT JOIN kids ON kids.node = n.node JOIN sub ON sub.node = n.node LEFT JOIN ends ON ends.node = n.node""",
    "op13_fim": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, {_H} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "quality_rule_counts": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
s AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS three FROM w WHERE len(w) > 2),
twice AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY r, three) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(3) AS u(j) GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nxt FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, t))
SELECT doc_id, n AS n_chars, sha256(substring(t, 1, n - n // 2) || substring(nxt, 1, n // 2)) AS edited_sha256 FROM e""",
}
