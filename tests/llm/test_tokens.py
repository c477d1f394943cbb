import random

import numpy as np
import pyarrow as pa

from sitequarry.llm.tokens import ByteBpe, public_path


def test_words_encoded_together_have_the_ids_of_each_alone(sf, spark):
    from tokenizers import Tokenizer

    path = public_path("byte_bpe_50k.json")
    bpe, library = ByteBpe(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    odd = ["", " ", "a", " a b", "a  b", "a b\n", "end\u3000", "x \u00a0 y", "it's we'll 'd", "a\nb c\n\nd", "12 3,4 --", "\x1c z\x1c", "日本 é🙂 ß", "a <|endoftext|> b", "w" * 40 + " " + "v" * 31]
    texts = odd + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rng.shuffle(texts)
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    calls, encode = [], bpe.encode
    bpe.encode = lambda text: calls.append(1) or encode(text)
    got = bpe.packed_all(texts)
    assert got == [np.array(x, bpe.kind).tobytes() for x in want]
    assert len(calls) < 4 * len(texts)  # not one for each new word


def test_each_different_word_of_a_batch_is_looked_up_once():
    class Counted(dict):
        lookups = 0

        def get(self, *key):
            self.lookups += 1
            return super().get(*key)

    bpe = ByteBpe(public_path("byte_bpe_50k.json"))
    bpe.words = Counted()
    texts = ["some words come again and again " * 200 + "end", "again some other words " * 300 + "end"]
    assert bpe.packed_all(texts) == [np.array(bpe.encode(x), bpe.kind).tobytes() for x in texts]
    assert bpe.words.lookups <= len({w for x in texts for w in x.split(" ")})


def test_a_column_of_odd_texts_has_the_ids_of_the_library():
    """Nulls, slices, white space of every kind at every place, special tokens, words that were cached before."""
    from tokenizers import Tokenizer

    path = public_path("byte_bpe_50k.json")
    bpe, library, rng = ByteBpe(path, cached=50), Tokenizer.from_file(path), random.Random(7)
    parts = ["a", "the", "Über", "it's", "'d", "12", "--", "é🙂", "日本", "<|endoftext|>", "w" * 40, *[" "] * 7, "\n", "\t", "\u3000", "\x85", "\x1c"]
    texts = [None, "", " ", "\n", "\n a", *["".join(rng.choices(parts[: rng.choice([9, 18, 18, 23])], k=rng.randrange(12))) for _ in range(3000)], None]
    end = np.array([0], bpe.kind).tobytes()
    column = pa.array(texts)
    for at in (0, 1, 100, 1000, 2900, len(texts)):
        got = bpe.packed_column(column[at : at + 900], end)
        assert got.to_pylist() == [np.array([*library.encode(x or "", add_special_tokens=False).ids, 0], bpe.kind).tobytes() for x in texts[at : at + 900]]
    assert bpe.packed_column(pa.array([None, ""], pa.string())).to_pylist() == [b"", b""]
