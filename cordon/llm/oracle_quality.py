"""SQL that gives the rows of the quality-rules query."""

from __future__ import annotations

from .divergence import COMMON_WORDS

_BLANK = r"[\x20\x09-\x0D]+"
_IN = ", ".join(f"'{w}'" for w in dict.fromkeys(COMMON_WORDS))
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
b AS (SELECT doc_id, lang, words, len(words) AS n_words, length(text) AS n_all,
             length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^0-9]+', '', 'g')) AS n_digit,
             length(regexp_replace(text, '[^.,;:!?]+', '', 'g')) AS n_stop,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
      FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM b WHERE n_words >= 3)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n >= 2),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
c AS (SELECT b.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
             n_words < 50 OR 100 * coalesce(r.n_repeat_words, 0) > 50 * n_words AS base_failed
      FROM b LEFT JOIN r USING (doc_id)),
h AS (SELECT doc_id, lang, base_failed, n_words, w, count(*) AS n
      FROM (SELECT doc_id, lang, base_failed, n_words, lower(unnest(words)) AS w FROM c) WHERE w IN ({_IN}) GROUP BY ALL),
total AS (SELECT lang, sum(n_words)::DOUBLE AS all_words, sum(n_all - word_chars)::DOUBLE AS c0, sum(n_upper)::DOUBLE AS c1, sum(n_digit)::DOUBLE AS c2,
                 sum(n_symbols)::DOUBLE AS c3, sum(n_stop)::DOUBLE AS c4, sum(word_chars - n_upper - n_digit - n_symbols - n_stop)::DOUBLE AS c5
          FROM c WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= 1000),
q AS (SELECT h.lang, w, sum(n) / any_value(all_words) AS q FROM h JOIN total USING (lang) WHERE NOT base_failed GROUP BY h.lang, w),
e AS (SELECT total.lang, coalesce(sum(q), 0) AS expected FROM total LEFT JOIN q USING (lang) GROUP BY total.lang),
cls AS (SELECT doc_id, lang, k, x / nullif(n_all, 0)::DOUBLE AS p FROM
          (SELECT doc_id, lang, n_all, unnest([0, 1, 2, 3, 4, 5]) AS k, unnest([n_all - word_chars, n_upper, n_digit, n_symbols, n_stop, word_chars - n_upper - n_digit - n_symbols - n_stop]) AS x FROM c)),
clq AS (SELECT lang, unnest([0, 1, 2, 3, 4, 5]) AS k, unnest([c0, c1, c2, c3, c4, c5]) / (c0 + c1 + c2 + c3 + c4 + c5) AS q FROM total),
cd AS (SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS char_distance
       FROM cls JOIN clq USING (lang, k) WHERE p IS NOT NULL GROUP BY doc_id),
hw AS (SELECT doc_id, sum(p) AS sp, sum(coalesce(q, 0)) AS sq,
              sum(p * log2(p / ((p + coalesce(q, 0)) / 2)) + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) AS s
       FROM (SELECT doc_id, h.lang, w, n / n_words::DOUBLE AS p, q FROM h LEFT JOIN q USING (lang, w)) GROUP BY doc_id),
wd AS (SELECT doc_id, expected * n_words AS guard, coalesce(s, 0) + expected - coalesce(sq, 0) AS s, 1 - coalesce(sp, 0) AS op, 1 - expected AS oq
       FROM c JOIN e USING (lang) LEFT JOIN hw USING (doc_id)),
wf AS (SELECT doc_id, sqrt(greatest((s + CASE WHEN op > 0 THEN op * log2(op / ((op + oq) / 2)) ELSE 0 END + CASE WHEN oq > 0 THEN oq * log2(oq / ((op + oq) / 2)) ELSE 0 END) / 2, 0)) AS word_distance
       FROM wd WHERE guard >= 10)
SELECT c.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(char_distance, 0) <= 0.27 AND coalesce(word_distance, 0) <= 0.13 + 2.0 / sqrt(greatest(n_words, 1)) AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM c LEFT JOIN cd USING (doc_id) LEFT JOIN wf USING (doc_id)
"""
