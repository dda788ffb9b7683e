"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from functools import wraps

from . import audit, codes, languages, media, mixing, near_dedup, pieces, quality, repeats, secrets, token_counts, vectors, warc
from .common import prepared


def _ready(query):
    @wraps(query)
    def run(spark, sf_dir):
        prepared(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_warc_archives": warc.query,
    "op2_audio_prints": media.query,
    "op3_near_vectors": vectors.query,
    "op4_quality": quality.query,
    "op5_near_dedup": near_dedup.query,
    "op6_pieces": pieces.query,
    "op7_secret_scan": secrets.query,
    "op8_repeats": repeats.query,
    "op9_token_counts": token_counts.query,
    "op10_mix_sources": mixing.query,
    "op11_languages": languages.query,
    "op12_vector_codes": codes.query,
    "op13_filter_audit": audit.query,
}
QUERIES = {name: _ready(query) for name, query in QUERIES.items()}

ORACLE_SQL = {
    "op1_warc_archives": warc.ORACLE_SQL,
    "op10_mix_sources": mixing.ORACLE_SQL,
    "op12_vector_codes": codes.ORACLE_SQL,
    "op13_filter_audit": audit.ORACLE_SQL,
}
