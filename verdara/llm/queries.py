"""Registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from verdara.llm.align import op13_tokenizer_alignment
from verdara.llm.bpe import op2_bpe
from verdara.llm.decontaminate import op6_decontaminate
from verdara.llm.embedding_dedup import op9_embedding_dedup
from verdara.llm.hard_negatives import op11_hard_negatives
from verdara.llm.html_text import op7_html_text
from verdara.llm.langid import op1_langid
from verdara.llm.lm_score import op5_lm_score
from verdara.llm.ngram_join import op10_ngram_join
from verdara.llm.packing import op12_packing
from verdara.llm.pii import op3_pii
from verdara.llm.quality import op8_quality
from verdara.llm.substring_dedup import op4_substring_dedup

QUERIES = {
    "op1_langid": op1_langid,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_decontaminate": op6_decontaminate,
    "op7_html_text": op7_html_text,
    "op8_quality": op8_quality,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_packing": op12_packing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "pipeline": corpus_pipeline.run,
}

#: Components by reachability over ``links(a, b)`` in both directions, for ``nodes(id)``.
_REACH = """reach AS (SELECT id AS node, id AS seen FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
part AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: For operators whose whole result SQL can express; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op4_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
named AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS s FROM spots),
twice AS (SELECT doc_id, i FROM named WHERE s IN (SELECT s FROM named GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM twice),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('lower(text)')} AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
it AS (SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM i),
m AS (SELECT doc_id, item_id, n, dt.p - it.p AS o, it.p AS p FROM dt JOIN it USING (t)),
need AS (SELECT doc_id, item_id, o FROM m GROUP BY ALL HAVING count(*) >= CASE WHEN max(n) < 7 THEN max(n) ELSE ceil(0.75 * least(12, max(n))) END),
k AS (SELECT a.doc_id, a.item_id, a.n, a.o, a.p, count(*) AS k FROM (SELECT * FROM m SEMI JOIN need USING (doc_id, item_id, o)) a JOIN m b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.o = b.o AND b.p BETWEEN a.p AND a.p + 11 GROUP BY ALL),
best AS (SELECT doc_id, item_id, CAST(max(k) AS INT) AS matched FROM k GROUP BY ALL HAVING max(k) >= CASE WHEN max(n) < 7 THEN max(n) ELSE ceil(0.75 * least(12, max(n))) END)
SELECT doc_id, list_sort(list(item_id)) AS item_ids, max(matched) AS matched FROM best GROUP BY doc_id""",
    "op9_embedding_dedup": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.vec_id <> y.vec_id WHERE list_inner_product(x.e, y.e) >= 0.9),
{_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM part LEFT JOIN n ON a = node""",
    "op10_ngram_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), nodes AS (SELECT doc_id AS id FROM d),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
{_REACH} SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM part LEFT JOIN size ON size.doc_id = node""",
    "op11_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
