"""The training-corpus pipeline: quality filter, near-duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor left; all but the last return the columns of
documents. The quality stage drops what the classifier scores under 0.5; of each group of near-duplicates one document stays;
personal data becomes pseudonyms; the mixing stage thins out domains that are above their target weight (no document is taken
twice); the last stage encodes the texts and decodes them again.
"""

from __future__ import annotations

import secrets
import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docsearch.llm import mixing, neardup, pieces, pii, quality
from docsearch.llm.common import cut, table

#: Target shares of tokens by domain of the mixing stage. They are a recipe, not a description of what comes in: at most one token in
#: two hundred from toxic text, enough for a model to know it and too little to take it up, and one in twenty from text of low quality,
#: which web queries hold and a model has to read. What is short of its share (the first stage leaves little of low quality) can't be
#: made more with a rate of 1 at most: it is kept whole, and the fit says so.
TARGETS = {"clean": 0.945, "low": 0.05, "toxic": 0.005}
#: The session setting that names the secret key of the pseudonyms, and the key where it is unset (local masters only: whoever has the
#: key can turn pseudonyms back).
KEY_SETTING, TEST_KEY = "spark.docsearch.pii.key", "key of test runs"
#: Random keys by application, of clusters whose sessions set none.
_drawn: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_copies(docs, neardup.Setting())


def secret_key(spark: SparkSession) -> str:
    """The key of the session. A cluster without one gets a random key for the application, as a known one would hide nothing: equal
    values are then linked in all that the application makes, but not to what others have made."""
    key = spark.conf.get(KEY_SETTING, None)
    if key or spark.sparkContext.master.startswith("local"):
        return key or TEST_KEY
    app = spark.sparkContext.applicationId
    if app not in _drawn:
        _drawn[app] = secrets.token_hex(32)
        warnings.warn(f"pipeline: {KEY_SETTING} is unset; pseudonyms are those of a random key, and other applications will have others", stacklevel=2)
    return _drawn[app]


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, secret_key(spark))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, table(spark, sf_dir, "labels"), TARGETS, max_rate=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, TOKENIZER)


STAGES = [
    ("quality classifier", filter_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("PII", hide_personal_data),
    ("mixing sources to target weights", mix_domains),
    ("SentencePiece encoding and decoding", encode),
]

#: The classifier, the pseudonyms and the token encoder can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
