import zlib

import numpy as np
import pandas as pd
import pytest
from helpers import SCHEMA, documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import packing as P
from paperloom.llm.encoding import encoder, tokenizer_path


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_encoder_equals_the_tokenizer(text):
    assert encoder().ids(text).tolist() == encoder().tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "It's", "ÉTÉ", "<|endoftext|>", "x\x1c", "12", "...", "\t", "é", "İ", "don't,", "straße"])).map(" ".join))
def test_encoder_on_words(text):
    assert encoder().ids(text).tolist() == encoder().tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files():
    other = encoder(tokenizer_path("byte_bpe_50k.json"))
    assert not other.fast and other.ids("Hello there").tolist() == other.tokenizer.encode("Hello there", add_special_tokens=False).ids


def check(pieces: pd.DataFrame, ids_of: dict, repeats: dict):
    assert (pieces["length"] > 0).all() and (pieces["length"] == pieces.ids.map(len) // 4).all()
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= s.tier.iloc[0] and s.tier.nunique() == 1
    for doc_id, d in pieces.groupby("doc_id", dropna=False):
        want = ids_of[None if pd.isna(doc_id) else doc_id]
        d = d.sort_values("start", kind="stable")
        got = sum((np.frombuffer(b, "<u4").tolist() for b in d.ids), []) if repeats.get(doc_id, 1) == 1 else None
        assert got is None or (got == want and (d.start == d.length.cumsum() - d.length).all())
        assert d.length.sum() == len(want) * repeats.get(doc_id, 1) and set(d.doc_tokens) == {len(want)}


def test_every_id_in_one_piece(spark):
    rows = documents()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids_of = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    pieces = P.pack(frame(spark).repartition(2)).toPandas()
    check(pieces, ids_of, {2: 3})
    filled = pieces.groupby("sequence_id").length.sum()
    assert (~filled.isin([256, 512, 1024, 2048])).sum() <= 2  # one for each task
    again = P.pack(frame(spark).repartition(2)).toPandas()
    assert sorted(map(str, pieces.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert P.pack(frame(spark, [], SCHEMA)).count() == 0


def test_packer_balances_steps_and_keeps_all():
    rng = np.random.default_rng(2)
    packer, made, ids_of = P.Packer(3, pool_tokens=200_000), [], {}
    for k in range(400):
        ids_of[k] = rng.integers(0, 9, int(rng.choice([1, 40, 256, 700, 1024, 2048, 5000]))).tolist()
        if packer.add(k, np.array(ids_of[k], "<u4")):
            made.append(packer.flush().to_pandas())
    made.append(packer.flush(last=True).to_pandas())
    check(pieces := pd.concat(made), ids_of, {})
    steps = pieces.drop_duplicates("sequence_id").groupby("step_id").tier.sum()
    assert (steps.sort_index()[:-1] == P.STEP_TOKENS).all() and steps.max() <= P.STEP_TOKENS and len(steps) > 20
    assert (pieces.sequence_id >= 3 << 36).all()


def test_query_crc(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = P.op8_packing(spark, str(tmp_path)).filter("doc_id = 26").collect()
    assert [(r["length"], r["ids_crc32"]) for r in rows] == [(1, zlib.crc32(np.array([1], "<u4").tobytes()))]


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    plain = P.pack(frame(spark).coalesce(1)).drop("ids").collect()
    other = P.pack(frame(spark).withColumns({n: F.lit("mine") for n in ("length", "ids", "tier", "offset")}).coalesce(1)).drop("ids").collect()
    assert sorted(map(str, plain)) == sorted(map(str, other))


def test_bad_tiers():
    with pytest.raises(ValueError):
        P.Packer(0, tiers=(100, 2048))
