"""Token ids of whole texts, by the tokenizers library, many times faster than text by text.

A byte-level BPE splits text into words before it merges, and some of these splits are certain whatever stands around:
before a blank that something other than white space follows, before a mark or a line feed after a letter. Texts are cut
there with array operations, a batch's distinct pieces are found by Arrow, each is encoded once while a worker remembers
it, and ids are put together again by a take. The bytes of each id tell where a piece ends.
"""

from __future__ import annotations

import gc
import os
import threading
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.common import give_back

TOKENIZER = "byte_bpe_50k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: Bytes whose places to cut are looked for at once.
WINDOW = 4 << 20


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def certain_cuts(data: np.ndarray) -> np.ndarray:
    """Where a text's bytes may be cut before: a blank that other than white space follows; a mark or line feed after a
    letter; a line feed after another visible ASCII character. What is not surely so (other scripts) is not cut."""
    visible = (data - 0x21) < 0x5E  # of ASCII; unsigned, so less wraps around
    letter = ((data | 0x20) - 0x61) < 26
    mark = visible & ~letter & ((data - 0x30) > 9)
    letter[1:] |= (data[:-1] == 0xC3) & ((data[1:] | 0x20) != 0xB7)  # the second byte of U+00C0 to U+00FF but two signs
    line = data == 0x0A
    # first bytes of characters that are not white space: U+00C0 and beyond, but not where the other blanks are
    solid = visible | ((data >= 0xC3) & ((data - 0xE1) > 2))
    cut = np.zeros(len(data), bool)
    cut[:-1] = (data[:-1] == 0x20) & solid[1:]
    cut[1:] |= (mark | line)[1:] & letter[:-1]
    cut[1:] |= line[1:] & visible[:-1]
    return cut


def cut_texts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' pieces one after the other, and for each text the number of pieces before it, then that of all."""
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return pa.array([], pa.large_string()), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = data.slice(int(ends[0]), int(ends[-1] - ends[0]))
    ends, flat = ends - ends[0], np.frombuffer(data, np.uint8)
    filled = ends[1:] > ends[:-1]
    starts, lasts = ends[:-1][filled], ends[1:][filled] - 1
    lasts = lasts[flat[lasts] == 0x20]  # what follows these is another text
    at = []
    for low in range(0, len(flat), WINDOW):
        high = min(low + WINDOW, len(flat))
        first = max(low - 1, 0)
        cut = certain_cuts(flat[first : high + 1])[low - first : high - first]
        for places, is_cut in ((lasts, False), (starts, True)):
            cut[places[np.searchsorted(places, low) : np.searchsorted(places, high)] - low] = is_cut
        at.append(np.flatnonzero(cut) + low)
    at = np.concatenate([*at, [len(flat)]]).astype(np.int64, copy=False)
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), data]), np.searchsorted(at, ends)


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """The array with room for at least `n`, zeros behind what it holds."""
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))


class Encoder:
    """Remembers the ids of `most_words` pieces; beyond them, it forgets those not asked for again. `most_pieces` of the
    texts are looked up at once. All is forgotten after `idle_s` seconds without work, as a worker outlives the stage
    that needs this."""

    def __init__(self, path: str, most_pieces: int = 4 << 20, most_words: int = 800_000, idle_s: float = 2.0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)  # one character a byte
        self.most_pieces, self.most_words = most_pieces, most_words
        self.idle_s, self.last, self.watched, self.lock = idle_s, 0.0, False, threading.Lock()
        self.forget()

    def _watch(self) -> None:
        while True:
            time.sleep(self.idle_s / 2)
            with self.lock:
                if time.monotonic() - self.last > self.idle_s:
                    self.watched = False
                    self.forget()
                    give_back()
                    return

    def forget(self) -> None:
        self.words: list[str] = []  # by number
        self.numbers: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, "<u4")
        self.ends = np.zeros(1 << 16, np.int64)  # bytes of ids before each word's, then of all
        self.asked = np.zeros(1 << 16, np.uint32)  # lookups that held the word, halved whenever words are forgotten

    def forget_rare(self) -> None:
        """Keeps words of two lookups or more, unless these are still many."""
        n = len(self.words)
        kept = np.flatnonzero(self.asked[:n] > 1)
        words, ids, ends, asked = self.words, self.ids, self.ends, self.asked[kept] // 2
        self.forget()
        if len(kept) <= self.most_words // 2:
            sizes = (ends[kept + 1] - ends[kept]) // 4
            ids = ids[: ends[n] // 4][np.repeat(np.isin(np.arange(n), kept, assume_unique=True), np.diff(ends[: n + 1]) // 4)]
            self.add([words[k] for k in kept.tolist()], ids, sizes)
            self.asked[: len(kept)] = asked

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Takes in words with their ids, one word's after the other's, and how many each has."""
        n, n_ids = len(self.words), int(self.ends[len(self.words)]) // 4
        self.numbers.update(zip(words, range(n, n + len(words)), strict=True))
        self.words += words
        self.ids = grown(self.ids, n_ids + len(ids))
        self.ids[n_ids : n_ids + len(ids)] = ids
        self.ends = grown(self.ends, len(self.words) + 1)
        self.ends[n + 1 : len(self.words) + 1] = (n_ids + np.cumsum(sizes)) * 4
        self.asked = grown(self.asked, len(self.words))

    def learn(self, fresh: list[str]) -> None:
        """Ids of new words."""
        after_blank, after_line, others = [], [], []
        for x in fresh:
            if x[0] == " " and len(x) > 1 and not x[1].isspace():
                after_blank.append(x)  # a cut before it is certain
            elif x[0] == "\n" and len(x) > 1 and not x[1].isspace() and not x[-1].isspace():
                after_line.append(x)  # and so it is here, as no white space comes before
            else:
                others.append(x)
        for words, together in ((after_blank, 4096), (after_line, 4096), (others, 1)):
            if words:
                self.learn_words(words, together)

    def learn_words(self, fresh: list[str], together: int) -> None:
        """Encodes words, `together` to a string: the library must cut the string where they meet."""
        joined = ["".join(fresh[k : k + together]) for k in range(0, len(fresh), together)]
        ids = np.concatenate([np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        sizes = np.fromiter(map(len, map(str.encode, fresh)), np.int64, len(fresh))
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes)) + 1
        self.add(fresh, ids, np.diff(ends, prepend=0))

    def look_up(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece, as bytes."""
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        numbers = list(map(self.numbers.get, words))
        fresh = [x for x, n in zip(words, numbers, strict=True) if n is None]
        if fresh:
            self.learn(fresh)
            numbers = map(self.numbers.__getitem__, words)
        numbers = np.fromiter(numbers, np.int64, len(words))
        self.asked[numbers] += 1
        known = pa.Array.from_buffers(pa.large_binary(), len(self.words), [None, pa.py_buffer(self.ends), pa.py_buffer(self.ids)])
        return pc.take(known, pa.array(numbers[coded.indices.to_numpy()]), boundscheck=False)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, unsigned 32-bit, and for each text their number up to its end. Null is an empty text."""
        pieces, before = cut_texts(column)
        ids, ends = [], [np.zeros(1, np.int64)]
        with self.lock:
            if not self.watched:
                self.watched = True
                threading.Thread(target=self._watch, daemon=True).start()
            collects = gc.isenabled()
            gc.disable()  # all that is made here is free of cycles, and there is much of it
            try:
                for at in range(0, len(pieces), self.most_pieces):
                    if len(self.words) > self.most_words:
                        self.forget_rare()
                    _, own, data = self.look_up(pieces.slice(at, self.most_pieces)).buffers()
                    own = np.frombuffer(own, np.int64)[1 : min(self.most_pieces, len(pieces) - at) + 1] // 4
                    ids.append(np.frombuffer(data, "<u4", int(own[-1])))
                    ends.append(own + ends[-1][-1])
            finally:
                if collects:
                    gc.enable()
            self.last = time.monotonic()
        ids = ids[0] if len(ids) == 1 else np.concatenate([np.empty(0, "<u4"), *ids])
        return ids, np.concatenate(ends)[before[1:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, ends[:-1]) if texts else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, whose pieces serve all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
