import glob
import random

import pyarrow.parquet as pq
import pytest
from odd import LONG, ROWS, none, odd, prose, table

from quillspark.llm import token_count as C
from quillspark.llm import token_output as O


def texts():
    r = random.Random(1)
    out = ["a", " a", "a ", "a  b", "\n\n a", "don't  stop\t", "1234567 89", "😀😀 x", "été", "a b", " ", "  "]
    out += ["".join(r.choice("ab 1\n'.é  ") for _ in range(r.randint(1, 40))) for _ in range(300)]
    return out + [prose(1, 200)]


def test_ids_are_the_tokenizers(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = texts()
    got = {r.doc_id: r for r in O.encode(table(spark, *enumerate(rows))).collect()}
    for i, x in enumerate(rows):
        assert got[i].tokens == t.encode(x, add_special_tokens=False).ids, x
        assert got[i].n_tokens == len(got[i].tokens) and O.decode_ids(got[i].tokens) == x


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, tmp_path, encoding):
    docs = table(spark, *((i, prose(i, 300), "en", f"s{i % 4}") for i in range(400)))
    made = O.encode(docs).coalesce(1)
    O.write_tokens(made, str(tmp_path / "t"), encoding, row_group_bytes=1 << 16, page_bytes=1 << 12, page_rows=50)
    f = pq.ParquetFile(glob.glob(str(tmp_path / "t" / "*.parquet"))[0])
    ids = [c for c in (f.metadata.row_group(0).column(k) for k in range(f.metadata.num_columns)) if c.path_in_schema.startswith("tokens")][0]
    assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta") and ids.has_offset_index and ids.has_column_index
    assert f.metadata.num_row_groups > 1
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.doc_id, tuple(r.tokens)) for r in back.collect()) == sorted((r.doc_id, tuple(r.tokens)) for r in made.collect())
    plan = O.read_metadata(back).where("source = 's1'")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema:")[1] and "EqualTo(source,s1)" in plan
    with pytest.raises(ValueError):
        O.write_tokens(made, str(tmp_path / "u"), "plain")


def test_output_of_odd_rows(spark):
    rows = O.token_output(odd(spark)).collect()
    assert len(rows) == len(ROWS) and all(r.tokens is not None and r.n_tokens == len(r.tokens) for r in rows)
    assert {r.doc_id: O.decode_ids(r.tokens) for r in rows}[8] == LONG
    assert sum(r.n_tokens == 0 for r in rows) == 3
    assert O.token_output(none(spark)).collect() == []


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = C.load_vocabulary(C.default_vocabulary())
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=C.SPACE, prepend_scheme="always", split=True)
    return t


def test_counts_are_the_tokenizers(spark):
    t = unigram()
    rows = texts()
    got = {r.doc_id: r.n_tokens for r in C.token_counts(table(spark, *enumerate(rows))).collect()}
    for i, x in enumerate(rows):
        assert got[i] == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_ties_and_unknown():
    from tokenizers import Tokenizer, models

    r = random.Random(4)
    for byte in (False, True):
        for _ in range(60):
            pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(8)} | {C.SPACE}
            vocab = [("<unk>", 0.0)] + [(p, -float(r.randint(1, 4))) for p in sorted(pieces)]
            vocab += [(f"<0x{b:02X}>", -9.0) for b in range(256)] if byte else []
            t, own = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte)), C.Counter(vocab)
            for _ in range(20):
                word = C.SPACE + "".join(r.choice("abcdé") for _ in range(r.randint(0, 9)))
                assert own.viterbi(word) == len(t.encode(word, add_special_tokens=False).ids), (vocab[:12], word)


def test_counts_of_odd_rows(spark):
    rows = C.token_counts(odd(spark)).collect()
    assert len(rows) == len(ROWS) and sum(r.n_tokens == 0 for r in rows) == 3
    whole = C.counter(C.default_vocabulary()).count(LONG)
    assert [r.n_tokens for r in rows if r.doc_id == 8] == [whole] and whole > 60_000
    assert C.token_counts(none(spark)).collect() == []
    small = C.Counter(C.load_vocabulary(C.default_vocabulary()), cache=0)
    assert small.count(prose(1, 50)) == C.counter(C.default_vocabulary()).count(prose(1, 50))
