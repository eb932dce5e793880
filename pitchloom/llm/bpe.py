"""BPE encoding and decoding over a trie of distinct words.

A word of symbols s1..sn has the BPE encoding t1..tk; cutting tokens off the end leaves the encodings
of prefixes, so a prefix is described by its last token alone. The last token of a prefix p is the
token t that ends p such that the last token u of p without t is compatible with it, that is, u
followed by t is left as it is by the merges (or t is all of p and encodes as itself). Distinct words
are inserted in a trie and the last tokens are propagated depth first, so prefixes that words share are
computed once; an encoding is read back from its leaf by jumping over tokens. Two tokens are compatible unless a
merge joins their facing edges, in whole or in part, before the merges that build them; it is decided once for each pair.

The vocabulary file is a parameter (a tokenizers JSON: NFC, white space to one space, lower case, a split pattern, bytes
as letters, a suffix at the last letter of a word). Strings of special tokens in a text become
their ids, as the tokenizers library does. What a worker remembers of the chunks between white space and their words is bounded in bytes
(``MEMORY_BYTES``), an entry being no more than the ids; texts are taken in groups of about ``TEXT_BYTES``, and a task that ends leaves nothing, not
even the vocabulary: its worker stays alive, and what it held would count against the stages that follow.

Nulls and empty texts have no tokens and decode to the empty text. Rows with null or repeated ids give one result row each; an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pitchloom.llm.common import bounded_batches, release

VOCABULARY = "word_bpe_49k.json"
#: Bytes that remembered chunks and words take at most, beside those of the texts at hand (results don't depend on it).
MEMORY_BYTES = 40 << 20
#: About what an entry takes beside its letters and ids: a key, a tuple and their places in a dictionary.
ENTRY_BYTES = 180
#: Letters of the texts that share one trie; a longer text is a group of its own.
TEXT_BYTES = 1 << 20
#: Pairs of tokens whose compatibility is remembered at most (about 80 bytes each).
PAIRS = 200_000
#: Letters below are classed and normalized here; texts and chunks with others by the library.
LATIN = "\u0250"
#: What str.split() takes as white space but Unicode's White_Space property does not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Memory:
    """Entries in two generations: what was used since the last turn, and what was used between the last two.

    A turn comes when the young ones take half of MEMORY_BYTES; the old ones that were not used again go.
    """

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def turn(self) -> None:
        """To be called while no key is in use."""
        if self.held > MEMORY_BYTES // 2:
            self.young, self.old, self.held = {}, self.young, 0

    def missing(self, keys: set) -> set:
        """Those keys without an entry; the entries of the others become young."""
        out = keys - self.young.keys()
        for k in out & self.old.keys():
            self.add(k, self.old[k])
            out.discard(k)
        return out

    def add(self, key: str | int, ids: tuple[int, ...]) -> None:
        self.young[key] = ids
        self.held += ENTRY_BYTES + 8 * len(ids) + (len(key) if isinstance(key, str) else 0)


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        #: The library's normalizer and pre-tokenizer, without the vocabulary.
        self.library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        name = {t: t for t in self.vocab}  # one string for each token, wherever it is used
        merges = [tuple(name.get(x, x) for x in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.word_re = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.space_re = regex.compile(r"\s+")
        self.letters = "".join(byte_letters()[b] for b in range(256))
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.text_of}
        end = self.suffix
        #: Tokens by their letters: those inside a word, and those at its end.
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(end) or t == end}
        self.final = {t[: -len(end)]: i for t, i in self.vocab.items() if t.endswith(end) and t != end}
        #: Lengths of the tokens that may end a prefix, or a word, by its last letters.
        self.ends_inner, self.ends_final = self._ends(self.inner), self._ends(self.final)
        self.fits: dict[int, bool] = {}  # by left << 32 | right
        self.alone: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[str, int, int]]] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for m in merges:
            self.halves.setdefault(name.get(whole := "".join(m), whole), m)
        made = {"".join(m): i for i, m in reversed(list(enumerate(merges)))}
        if any(max(made.get(a, -1), made.get(b, -1)) >= i for i, (a, b) in enumerate(merges)):
            raise ValueError("a merge precedes the merges of its parts: not a trained BPE vocabulary")
        self.forget()

    def forget(self) -> None:
        """Empty the memory of chunks and words."""
        self.chunks = Memory()

    @staticmethod
    def _ends(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """By the last three letters of tokens, or all of a shorter one: lengths of the tokens with that end, and of those within it, longest first."""
        found: dict[str, set[int]] = {}
        for t in tokens:
            found.setdefault(t[-3:], set()).add(len(t))
        for end, lengths in found.items():
            lengths.update(n for n in range(1, len(end)) if end[-n:] in tokens)
        shared: dict[tuple[int, ...], tuple[int, ...]] = {}
        return {end: shared.setdefault(x := tuple(sorted(lengths, reverse=True)), x) for end, lengths in found.items()}

    @staticmethod
    def _lengths(ends: dict[str, tuple[int, ...]], word: str, end: int) -> tuple[int, ...]:
        """Lengths of the tokens that may end word[:end]."""
        tail = word[end - 3 if end > 3 else 0 : end]
        return ends.get(tail) or ends.get(tail[-2:]) or ends.get(tail[-1:], ())

    def _symbols(self, token: str) -> tuple[str, ...]:
        """Letters of a token; the suffix belongs to the last one."""
        if token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return (*body[:-1], body[-1] + self.suffix)
        return tuple(token)

    def _replay(self, symbols: tuple[str, ...]) -> list[str]:
        """The merges applied to a few symbols, lowest rank first, leftmost first."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, token: int) -> bool:
        if token not in self.alone:
            self.alone[token] = len(self._replay(self._symbols(self.text_of[token]))) == 1
        return self.alone[token]

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
                self.edges.clear()
            found = self.fits[key] = self._whole(left) and self._whole(right) and not self._crossed(left, right)
        return found

    def _edges(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """What stands at one edge of a token while it is built: symbol, rank that makes it, rank that takes it."""
        out, taken = [], len(self.rank)
        while token in self.halves:
            made = self.rank[self.halves[token]]
            out.append((token, made, taken))
            token, taken = self.halves[token][side], made
        return [*out, (token, -1, taken)]

    def _crossed(self, left: int, right: int) -> bool:
        """Whether some merge joins the right edge of one token with the left edge of the next before either is built.

        Merges run by rank and, within a rank, from the left: at equal rank the left token's own merge comes first.
        """
        key = (left, right)
        for token, side in zip(key, (1, 0), strict=True):
            if (token, side) not in self.edges:
                self.edges[token, side] = self._edges(self.text_of[token], side)
        for a, made_a, taken_a in self.edges[left, 1]:
            for b, made_b, taken_b in self.edges[right, 0]:
                rank = self.rank.get((a, b))
                if rank is not None and max(made_a, made_b) < rank < taken_a and rank <= taken_b:
                    return True
        return False

    def _last(self, word: str, end: int, last: list) -> tuple[int, int]:
        """Last token of the inner prefix of length ``end`` and its length; those of shorter prefixes are made as they are asked for.

        A prefix whose candidates wait for that of a shorter one stays on a stack, so depth does not depend on the word's length.
        """
        inner, ends, fits = self.inner.get, self.ends_inner, self.fits.get
        waiting = []
        lengths = iter(self._lengths(ends, word, end))
        length = next(lengths, 0)
        while length:
            start = end - length
            token = inner(word[start:end]) if start >= 0 else None
            if token is not None:
                if start and last[start] is None:
                    waiting.append((end, lengths, length))
                    end, lengths = start, iter(self._lengths(ends, word, start))
                    length = next(lengths, 0)
                    continue
                if start:
                    left = last[start][0]
                    good = fits(left << 32 | token)
                    if good is None:
                        good = self._compatible(left, token)
                else:
                    good = self._whole(token)
                if good:
                    last[end] = token, length
                    if not waiting:
                        return last[end]
                    end, lengths, length = waiting.pop()
                    continue
            length = next(lengths, 0)
        raise ValueError(f"no token ends the prefix {word[:end]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word (in byte letters), by one depth-first pass over their trie.

        In sorted order words come as the leaves of their trie do, depth first: the path of a word keeps the nodes that it shares
        with the word before. Of the others those are computed that some candidate for a last token rests on; a word that is
        a token which encodes as itself rests on none.
        """
        out: dict[str, list[int]] = {}
        last: list[tuple[int, int] | None] = [None]  # of each inner prefix on the path, by its length, None where nothing asked for it
        final, ends, fits = self.final.get, self.ends_final, self.fits.get
        before = ""
        for word in sorted(words):
            token = final(word)
            if token is not None and self._whole(token):
                out[word] = [token]
                continue
            n = len(word)
            shared, most = 0, min(n, len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            last += [None] * (n - 1 - shared)
            before = word
            for length in self._lengths(ends, word, n):
                start = n - length
                token = final(word[start:]) if start > 0 else None
                if token is not None:
                    left = (last[start] or self._last(word, start, last))[0]
                    good = fits(left << 32 | token)
                    if self._compatible(left, token) if good is None else good:
                        break
            else:
                raise ValueError(f"no token ends the word {word!r}")
            ids, at = [token], start
            while at:
                step = last[at] or self._last(word, at, last)
                ids.append(step[0])
                at -= step[1]
            ids.reverse()
            out[word] = ids
        return out

    def normalize(self, text: str) -> str:
        """NFC and lower case letter by letter; white space is left to the split.

        Beyond Latin letters, whose properties depend on the Unicode version, the library's own normalizer is asked.
        """
        if text.isascii():
            return text.lower()
        if max(text) < LATIN:
            return unicodedata.normalize("NFC", text).lower()
        return self.library.normalizer.normalize_str(text)

    def _lettered(self, word: str) -> str:
        return codecs.charmap_decode(word.encode(), "strict", self.letters)[0]

    def _cut(self, chunk: str) -> list[str]:
        """Words of a chunk; each of them is a chunk of one word, too."""
        if chunk.isascii() or max(chunk) < LATIN:
            return [chunk] if chunk.isalpha() else self.word_re.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def _learn(self, chunks: set[str]) -> None:
        cut = {c: self._cut(c) for c in chunks}
        several = {c: parts for c, parts in cut.items() if parts != [c]}
        words = cut.keys() - several.keys()
        words |= self.chunks.missing(set().union(*several.values()) - words)
        # Printable ASCII is its own byte letters.
        lettered = {w if w.isascii() and w.isprintable() else self._lettered(w): w for w in words}
        add, learned = self.chunks.add, self.chunks.young
        for letters, ids in self.encode_words(lettered).items():
            add(lettered[letters], tuple(ids))
        for c, parts in several.items():
            add(c, tuple(chain.from_iterable([learned[w] for w in parts])))

    def _split(self, text: str) -> list[str]:
        return [c for c in self.space_re.split(text) if c] if any(s in text for s in SEPARATORS) else text.split()

    def _parts(self, text: str) -> list:
        """Chunks between white space, and ids of special tokens."""
        if "<|" not in text or not self.special_re:
            return self._split(self.normalize(text))
        parts, at = [], 0
        for m in self.special_re.finditer(text):
            parts += [*self._split(self.normalize(text[at : m.start()])), self.special[m.group()]]
            at = m.end()
        return parts + self._split(self.normalize(text[at:]))

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        """For each text its ids as decimals joined by spaces, their number, and the text decoded from them.

        All chunks of the batch that are not remembered are encoded together, over one trie. No object made here refers back to
        itself, so the search for such garbage, which would go through all entries, rests meanwhile.
        """
        searched = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            if searched:
                gc.enable()

    def _encode_batch(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        cut = [self._parts(t or "") for t in texts]
        self.chunks.turn()
        fresh = self.chunks.missing(set().union(*cut))
        special = {c for c in fresh if isinstance(c, int)}
        for c in special:
            self.chunks.add(c, (c,))
        self._learn(fresh - special)
        ids_of, out = self.chunks.young.__getitem__, []
        for parts in cut:
            ids = list(chain.from_iterable(map(ids_of, parts)))
            out.append((" ".join(map(self.decimal.__getitem__, ids)), len(ids), self.decode(ids)))
        return out

    def encode(self, text: str | None) -> tuple[str, int, str]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the file names no decoder, so tokens are joined by spaces, as the tokenizers library does."""
        return " ".join(map(self.text_of.__getitem__, ids))


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts that hold about TEXT_BYTES together, or are a single longer text."""
    sizes = texts.cast(pa.binary()).fill_null(b"")
    start = held = 0
    for i, n in enumerate(pc.binary_length(sizes).to_pylist()):
        if i > start and held + n > TEXT_BYTES:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(texts) > start:
        yield start, len(texts) - start


def encode_decode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The columns of ``keep``, with ids (string of decimals, if asked for), n_tokens, ids_sha256 and decoded_sha256 of each text."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(["ids string"] if ids else []), "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    names = [*keep, *(["ids"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        bpe = Bpe(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at, n in groups(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, n)
                coded = bpe.encode_batch(part.column(part.num_columns - 1).to_pylist())
                columns = [*part.columns[: len(keep)], *([pa.array([c[0] for c in coded], pa.string())] if ids else [])]
                columns += [pa.array([c[1] for c in coded], pa.int64()), pa.array([sha(c[0]) for c in coded]), pa.array([sha(c[2]) for c in coded])]
                del coded
                yield pa.RecordBatch.from_arrays(columns, names=names)
        del bpe
        release()

    return bounded_batches(docs).select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)
