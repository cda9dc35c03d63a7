import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from millrace.llm import tokens
from millrace.llm.tokens import Encoder, default_tokenizer


def plain(texts):
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_equals_the_library(spark):
    rng = random.Random(3)
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", " \n x", "\n x", "x \n", "it's  'll", "tab\t x", "a\xa0 b  c", "<|endoftext|> x", "é ü ß 漢字 😀 x", "1 22 333 . , ;;", "a\x1c b \x85c", "‍ x"]
    alphabet = ["a", "the", " ", " ", "\n", "\t", "'s", "é", "1", ".", "\xa0", "\x1c", "漢", "%", "　", "x's"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    e = Encoder(default_tokenizer(), most_pieces=2000, most_words=3000)
    for at in range(0, len(texts), 300):
        got = [x.tolist() for x in e.encode(texts[at : at + 300])]
        assert got == plain(texts[at : at + 300])


def test_forgets_when_idle():
    import time

    e = Encoder(default_tokenizer(), idle_s=0.2)
    first = e.encode(["some words to remember"])[0].tolist()
    assert e.words and e.numbers
    time.sleep(1)
    assert not e.words and not e.numbers
    assert e.encode(["some words to remember"])[0].tolist() == first


WORKER = """
import random, re, time
from pathlib import Path
import pyarrow as pa
from millrace.llm.packing import _to_pieces
from millrace.llm.tokens import default_tokenizer, encoder

held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
encoder(default_tokenizer()).idle_s = 0.2
before, rng = held(), random.Random(1)

def batches():
    for _ in range(6):
        texts = [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(200)) for _ in range(300)]
        yield pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["id", "text"])

rows = sum(x.num_rows for x in _to_pieces(default_tokenizer(), 1024, 2, False)(batches()))
time.sleep(2)
print(rows, held() - before)
"""


def test_an_idle_worker_keeps_little_of_its_work():
    rows, more = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True).stdout.split()
    assert int(rows) >= 1800 and float(more) < 48  # MB


def test_a_word_is_learnt_once_whatever_mark_or_line_feed_follows():
    words, after = [f"w{'abcdefgh'[k // 8]}{'élmnopqr'[k % 8]}" for k in range(64)], ["", ".", ",", "!?", ";\n", ".***", "'s", "\n"]
    texts = [" " + " ".join(w + x for w in words) + " end" for x in after]
    e = Encoder(default_tokenizer())
    assert [x.tolist() for x in e.encode(texts)] == plain(texts)
    assert len(e.numbers) <= len(words) + len(after) + 1


class Counting(dict):
    asked = 0

    def get(self, key):
        self.asked += 1
        return super().get(key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_words_are_looked_up_once_a_batch():
    e = Encoder(default_tokenizer())
    e.numbers = Counting(e.numbers)
    texts = [" one two three, four." * 500] * 20
    assert [x.tolist() for x in e.encode(texts)] == plain(texts)
    assert e.numbers.asked <= 2 * 6


def test_columns_with_nulls_windows_and_slices(monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 16)
    rng = random.Random(8)
    alphabet = ["a", "the", " ", " ", "\n", "\t", "'s", "é", "×", "1", ".", ",", "\xa0", "\x85", "\u2003", "\u1680", "漢", "e\u0301", "Ж"]
    texts = [rng.choice([None, "", "".join(rng.choices(alphabet, k=rng.randint(1, 60)))]) for _ in range(400)]
    e = Encoder(default_tokenizer(), most_pieces=30)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind).slice(7, 300)
        ids, ends = e.encode_column(column)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == plain([x or "" for x in column.to_pylist()])
    for column in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        ids, ends = e.encode_column(column)
        assert not len(ids) and ends.tolist() == [0] * len(column)


def test_words_asked_for_again_are_kept():
    e = Encoder(default_tokenizer(), most_words=300)
    for k in range(20):
        texts = [f"some often seen words n{chr(97 + k)}{chr(97 + j // 26)}{chr(97 + j % 26)}x" for j in range(100)]
        assert [x.tolist() for x in e.encode(texts)] == plain(texts)
        assert len(e.words) == len(e.numbers) <= 410
    assert {"some", " often", " seen", " words"} <= e.numbers.keys() and e.asked[e.numbers[" often"]] > 1
