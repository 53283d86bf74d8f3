"""Queries over the operators of this subpackage, for the driver's entry module."""

from __future__ import annotations

from . import archives, divergence, hard_negatives
from .archives import op13_warc
from .divergence import op11_source_divergence
from .embedding_dedup import op2_embedding_dedup
from .hard_negatives import op12_hard_negatives
from .language_id import op4_language_id
from .license_scan import op1_license_scan
from .minhash_dedup import op7_minhash_dedup
from .mixing import op10_mixing
from .packing import op9_packing
from .quality_pu import op5_quality
from .quality_rules import op8_quality_rules
from .sharding import op6_sharding
from .token_count import op3_token_count


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_count": op3_token_count,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
    "pipeline": _pipeline,
}
#: op2: all pairs and the transitive closure, small enough at the sizes where it is run.
ORACLE = {
    "op11_source_divergence": divergence.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_warc": archives.SQL,
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN component c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
}
