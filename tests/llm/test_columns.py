"""Extra columns, whatever their names, change no operator's rows; empty tables give none."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from quorumlake.llm import decontam, mixing, pii, quality, sharding, simhash, substring, suffix, tokens

from .conftest import SF
from .test_identity import CLASH

MORE = (*CLASH, "pos", "windows", "rank", "rn", "fp", "root", "times", "source_size", "taken", "n_tokens", "span", "start", "all", "pieces", "stratum_", "w", "l", "block", "low", "sh", "item_id", "prefix_", "kept", "node", "many")


def _tokens(d, bench, labels):
    import public_tokenizers

    return tokens.count_tokens(d, public_tokenizers.path("word_bpe_49k.json"))


OPERATORS = {
    "op1": lambda d, bench, labels: pii.digest(pii.find(d)),
    "op1 redact": lambda d, bench, labels: pii.redact(d),
    "op2": lambda d, bench, labels: substring.remove_repeats(d),
    "op3": lambda d, bench, labels: mixing.mix(d),
    "op4": lambda d, bench, labels: simhash.near_duplicates(d),
    "op5": lambda d, bench, labels: decontam.contaminated(d, bench),
    "op6": _tokens,
    "op7": lambda d, bench, labels: suffix.remove_repeats(d),
    "op8": lambda d, bench, labels: sharding.assign(d, 5000),
    "op9": lambda d, bench, labels: quality.judge(d, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns(spark, docs, odd_docs, name):
    bench, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "labels"))
    plain = docs.limit(30).select("doc_id", "text", "lang", "source").union(odd_docs.select("doc_id", "text", "lang", "source"))
    rows = spark.createDataFrame(plain.collect(), plain.schema)
    wide = rows.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(dict.fromkeys(MORE))])
    op = OPERATORS[name]
    narrow, got = op(rows, bench, labels), op(wide, bench, labels)
    assert got.columns == narrow.columns
    assert Counter(map(str, map(tuple, got.collect()))) == Counter(map(str, map(tuple, narrow.collect())))
    empty = op(rows.limit(0), bench, labels)
    assert empty.columns == narrow.columns and empty.count() == 0
