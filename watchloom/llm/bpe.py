"""Byte-pair encoding without merging, and decoding by an offset table.

The vocabulary is a ``tokenizers`` JSON file of a word-level byte BPE whose last symbol of a word
carries a suffix. A word is encoded left to right: an Aho-Corasick automaton gives the longest token
that starts at each place, and a token may follow another only if the pair is compatible, that
is, if merging the two strings in rank order gives just these two tokens. Where no token fits, the encoder steps
back and takes the next shorter one. Compatibility of each pair of neighbours makes the sequence the one that
merging finds, so each place is visited a bounded number of times and the work is linear.

Whether a pair is compatible is read off the merge trees of the two tokens, along the sides that touch.
Pairs are kept in a table filled as they occur, words and what stands between white space in two generations of bounded
size; what is dropped is worked out again, which costs time only. Where neither the normaliser nor the pre-tokeniser of the file looks
beyond white space, a text is cut there first, and only pieces not met before are lower-cased and split.

The file's own normaliser and pre-tokeniser are read; a part that is not known here is refused. Letters and digits are those
of the library's Unicode table.
Null texts count as empty, texts may be of any length, other columns but ``tokens`` and ``decoded`` pass through, and an empty table gives no rows.

Decoding looks every id up in one byte string of all tokens by offsets. Like the library without a
decoder, tokens are joined by one space.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.storage import bounded

_FULL = 150_000
_NEVER = 1 << 60
#: Longest piece between white space that is kept.
_PIECE = 64
#: Steps and pattern that treat each piece between white space on its own, but for NFC, which is done before.
_PIECEWISE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECEWISE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space for ``str.split``, not for the library.
_NO_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is a visible Latin-1 one, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def _parts(spec: dict | None, many: str) -> list[dict]:
    return [] if spec is None else spec[many] if spec["type"] == "Sequence" else [spec]


# Letters and digits that the library's Unicode table (version 16) does not have yet, and its lower-case letters that Python's older one lacks.
NEWER = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a"
    "\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2"
    "\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed"
    "\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479"
)
LOWER = {"\u1c89": "\u1c8a", "\ua7cb": "\u0264", "\ua7cc": "\ua7cd", "\ua7da": "\ua7db", "\ua7dc": "\u019b", "\ua7ce": "\ua7cf", "\ua7d2": "\ua7d3", "\ua7d4": "\ua7d5"} | {chr(0x10D50 + k): chr(0x10D70 + k) for k in range(22)} | {chr(0x16EA0 + k): chr(0x16EBB + k) for k in range(25)}
_LOWER = str.maketrans({"Σ": "σ"} | LOWER)


def _lower(text: str) -> str:
    """Lower case letter by letter, so without the final form of sigma."""
    return text.translate(_LOWER).lower() if not text.isascii() else text.lower()


def _step(spec: dict):
    """A normaliser of the file as a function; one that is not known here is refused."""
    if spec["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
        return partial(unicodedata.normalize, spec["type"])
    if spec["type"] == "Lowercase":
        return _lower
    if spec["type"] == "Replace" and "Regex" in spec["pattern"]:
        import regex

        return partial(regex.compile(spec["pattern"]["Regex"]).sub, spec["content"])
    if spec["type"] == "Replace" and "String" in spec["pattern"]:
        return lambda text: text.replace(spec["pattern"]["String"], spec["content"])
    raise ValueError(f"unknown normaliser {spec['type']}")


def _split_pattern(parts: list[dict]) -> str:
    """The pattern whose matches are the words: a split that keeps these alone, then bytes as they are."""
    kinds = [p["type"] for p in parts]
    if kinds != ["Split", "ByteLevel"] or not parts[0].get("invert") or parts[0]["behavior"] != "Removed" or parts[1].get("add_prefix_space") or parts[1].get("use_regex"):
        raise ValueError(f"unknown pre-tokeniser {kinds}")
    return parts[0]["pattern"]["Regex"]


class BpeCodec:
    def __init__(self, spec: str):
        # only this operator needs them
        import ahocorasick
        import regex

        j = json.loads(spec)
        model = j["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        normalisers = _parts(j["normalizer"], "normalizers")
        self.steps = [_step(n) for n in normalisers]
        pattern = _split_pattern(_parts(j["pre_tokenizer"], "pretokenizers"))
        self.piecewise = normalisers == _PIECEWISE and pattern == _PIECEWISE_SPLIT
        # white space as the library's engine has it; splitting drops it, so it need not be collapsed first
        known = pattern.replace(r"\s", r"\p{White_Space}")
        for kind in ("L", "N"):
            known = known.replace(f"[\\p{{{kind}}}]", f"[\\p{{{kind}}}--[{NEWER}]]")
        known = known.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{NEWER}]]")
        self.split = regex.compile(known, regex.V1)
        self.split_ascii = re.compile(pattern.replace(r"\s", r"\t-\r ").replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"))
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.bytes = byte_symbols()
        self.end = "\x00"  # stands for the suffix, as one character
        vocab = {self._inner(t): i for t, i in model["vocab"].items()}
        self.rank = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[self._inner(a), self._inner(b)] = k
        self.reachable = {t for t in vocab if len(t.rstrip(self.end)) == 1} | {a + b for a, b in self.rank}
        self.automaton = ahocorasick.Automaton()
        for t in self.reachable:
            self.automaton.add_word(t[::-1], t)
        self.automaton.make_automaton()
        # what each token is merged from, and when
        self.tree: dict[str, tuple[str, str, int]] = {}
        twice = set()
        for (a, b), k in self.rank.items():
            if a + b in self.tree:
                twice.add(a + b)
            else:
                self.tree[a + b] = (a, b, k)
        for token in twice:
            a, b = self._last_merge(token)
            self.tree[token] = (a, b, self.rank[a, b])
        self.spines: dict[tuple[str, bool], list[tuple[str, int]]] = {}
        self.whole: dict[str, bool] = {}
        self.id_bytes = {t: int(i).to_bytes(4, "little") for t, i in vocab.items()}
        self.shorter: dict[str, str | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        texts = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        pieces = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.table = np.frombuffer(b"".join(pieces), np.uint8)

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + self.end if self.suffix and token.endswith(self.suffix) and token != self.suffix else token

    def _merged(self, text: str, keep_last: bool = False) -> list[str]:
        """Merging in rank order: what a whole word must come to; with ``keep_last`` the parts before the last merge."""
        parts = list(text)
        if len(parts) > 1 and parts[-1] == self.end:
            parts[-2:] = [parts[-2] + self.end]
        while len(parts) > 1:
            ranks = [self.rank.get(p, _NEVER) for p in zip(parts, parts[1:])]
            k = min(ranks)
            if k == _NEVER or keep_last and len(parts) == 2:
                break
            at = ranks.index(k)
            a, b = parts[at], parts[at + 1]
            out, i = parts[:at], at
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _last_merge(self, token: str) -> tuple[str, str]:
        a, b = self._merged(token, True)
        return a, b

    def _spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The parts that touch one end of a token while it is merged, each with the rank that consumes it."""
        key = (token, right)
        if key not in self.spines:
            path, t = [(token, _NEVER)], token
            while t in self.tree:
                a, b, k = self.tree[t]
                t = b if right else a
                path.append((t, k))
            self.spines[key] = path[::-1]
        return self.spines[key]

    def _fits(self, a: str, b: str) -> bool:
        """Compatible: no merge across the border comes before those that take its two sides away.

        Of equal ranks the one further left comes first.
        """
        found = self.pairs.get((a, b))
        if found is not None:
            return found
        left, right, i, j, rank = self._spine(a, True), self._spine(b, False), 0, 0, self.rank
        while True:
            (x, gone_x), (y, gone_y) = left[i], right[j]
            k = rank.get((x, y), _NEVER)
            if k < gone_x and k <= gone_y and k != _NEVER:
                found = False
                break
            if gone_x == _NEVER and gone_y == _NEVER:
                found = True
                break
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1
        if len(self.pairs) > _FULL:
            self.pairs.clear()
        self.pairs[a, b] = found
        return found

    def _next_shorter(self, token: str) -> str | None:
        if token not in self.shorter:
            body = token[:-1]
            while body and body not in self.reachable:
                body = body[:-1]
            self.shorter[token] = body or None
        return self.shorter[token]

    def tokens(self, word: str) -> list[str]:
        """Tokens of one word, given in byte symbols with its end mark."""
        if word in self.reachable:
            if word not in self.whole:
                self.whole[word] = self._merged(word) == [word]
            if self.whole[word]:
                return [word]
        n = len(word)
        longest: list[str] = [""] * n
        # matches of the reversed strings end where the tokens start
        for end, token in self.automaton.iter(word[::-1]):
            at = n - 1 - end
            if len(token) > len(longest[at]):
                longest[at] = token
        out: list[str] = []
        at, token = 0, longest[0]
        dead = set()
        while True:
            follows = at + len(token)
            if follows != n - 1 and follows not in dead and (not out or self._fits(out[-1], token)):
                out.append(token)
                at = follows
                if at == n:
                    return out
                token = longest[at]
                if token:
                    continue
                raise ValueError(f"no token for {word[at:]!r}")
            nxt = self._next_shorter(token)
            if nxt is None:  # step back
                dead.add(at)
                token = out.pop()
                at -= len(token)
                nxt = self._next_shorter(token)
                while nxt is None and out:
                    dead.add(at)
                    token = out.pop()
                    at -= len(token)
                    nxt = self._next_shorter(token)
                if nxt is None:
                    raise ValueError(f"no tokens for {word!r}")
            token = nxt

    def _word(self, word: str) -> bytes:
        if len(self.words) >= _FULL:  # two generations: what is still used moves to the new one
            self.older = dict(self.words)
            self.words.clear()
        found = self.older.get(word)
        if found is None:
            table, ids = self.bytes, self.id_bytes
            visible = word.isascii() and word.isprintable()  # its bytes stand for themselves
            inner = (word if visible else "".join([table[b] for b in word.encode()])) + self.end
            found = b"".join([ids[t] for t in self.tokens(inner)])
        self.words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """Ids of what stands between white space."""
        if len(self.pieces) >= _FULL:
            self.older_pieces = dict(self.pieces)
            self.pieces.clear()
        found = self.older_pieces.get(piece)
        if found is None:
            text, known, word = _lower(piece), self.words, self._word
            if text.isascii():
                words = [text] if text.isalpha() else self.split_ascii.findall(text)
            else:
                words = self.split.findall(text)
            found = b"".join([known.get(w) or word(w) for w in words])
        if len(piece) <= _PIECE:
            self.pieces[piece] = found
        return found

    def _plain(self, text: str) -> bytes:
        if self.piecewise and not _NO_SPACE.search(text):
            known, piece = self.pieces, self._piece
            return b"".join([known.get(p) or piece(p) for p in unicodedata.normalize("NFC", text).split()])
        for step in self.steps:
            text = step(text)
        known, word = self.words, self._word
        return b"".join([known.get(w) or word(w) for w in self.split.findall(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of neighbouring texts; of those that are equal one is encoded."""
        held = {t: self.encode(t) for t in dict.fromkeys(texts)}
        return [held[t] for t in texts]

    def decode(self, ids: bytes) -> bytes:
        """Text of the ids in UTF-8, by the offset table."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return b""
        start, size = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        into = np.cumsum(size)
        at = np.repeat(start - (into - size), size) + np.arange(int(into[-1]))
        return self.table[at].tobytes()[:-1]


_CODECS: dict[str, BpeCodec] = {}


def _codec(name: str) -> BpeCodec:
    """The codec of a shipped vocabulary, built once per Python worker."""
    if name not in _CODECS:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _CODECS[name] = BpeCodec(f.read())
    return _CODECS[name]


def _shipped(docs: DataFrame, vocabulary: str) -> str:
    sc = bounded(docs.sparkSession).sparkContext
    name = vocabulary.rsplit("/", 1)[-1]
    if not any(f.endswith("/" + name) for f in sc.listFiles):
        sc.addFile(vocabulary)
    return name


def encode_table(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``tokens`` (array of int), ``decoded`` (string); null texts count as empty."""
    name = _shipped(docs, vocabulary)
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = codec.encode_all(part.column(part.schema.get_field_index(text)).to_pylist())
                cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                part = part.append_column("tokens", pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)))
                yield part.append_column("decoded", pa.array([codec.decode(x).decode() for x in ids], pa.string()))

    docs = docs.drop("tokens", "decoded")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("tokens", ArrayType(IntegerType())), StructField("decoded", StringType())]))


def digest_table(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    name = _shipped(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = codec.encode(t.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
