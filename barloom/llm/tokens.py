"""Exact subword encoding with a cache of encoded chunks, for use inside tasks.

A text is cut at places where the tokenizer cuts as well, whatever stands on
either side, so each chunk is encoded on its own and its ids are remembered.
Natural text repeats its words, so most chunks cost one dictionary lookup.
New chunks of plain Latin text are encoded together, as one text. Of a word
with signs after it, word and signs are looked up apart.
"""

from __future__ import annotations

import os
import re

from barloom.llm.common import kept

TOKENIZER_FOLDER = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZER_FOLDER}/{name}"


class ChunkEncoder:
    """``encode(text)``: the ids of ``text`` as little-endian unsigned 32-bit integers in bytes.

    Params: ``path``, a file of the tokenizers library; ``spaces``: 'dropped'
    if the tokenizer drops white space and marks the ends of words, 'kept' if
    a space may belong to the word after it; ``cache_chars``: chunks are kept
    in two generations of half as many characters each, which bounds the
    memory; a chunk that is met again moves to the younger one.

    The special tokens' strings in a text are ordinary text.
    """

    GROUP_CHARS = 1 << 20
    #: White space and then the characters up to the next space or line feed.
    _PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    #: Characters that no normal form changes and that have one lower-case letter.
    _PLAIN = re.compile(r"\n?[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")
    #: A word and at most one run of signs after it.
    _WORD = re.compile(r"[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+([!-&(-/:-@\[-`{-~]+)?")
    #: Signs that are a pre-token apart from the letter before them.
    _SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: The pre-tokens of the two kinds of byte-level tokenizers.
    _PRE_TOKENS = {
        True: r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+",
        False: r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    }

    def __init__(self, path: str, spaces: str, cache_chars: int = 10_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import codecs

        import numpy as np
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        # the same model for pre-tokens that are cut and written in byte letters already
        self._model = Tokenizer(self._tok.model)
        self._model.pre_tokenizer = CharDelimiterSplit("\t")
        vocabulary = self._tok.get_vocab(with_added_tokens=True)
        self.vocabulary = self._tok.get_vocab_size(with_added_tokens=True)
        self._dropped = spaces == "dropped"
        self._limit, self._chars = cache_chars // 2, 0
        self._cache: dict[str, bytes | None] = {"\0\0": None}
        self._older: dict[str, bytes | None] = {}
        self._pre_tokens = regex.compile(self._PRE_TOKENS[self._dropped]).findall
        # byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        letters = {b: 256 + k for k, b in enumerate(others)} | {9: 9}
        self._letters = "".join(chr(letters.get(b, b)) for b in range(256))
        self._decode = codecs.charmap_decode
        # tokens that begin with a space or a line feed, or that end a word
        size = 1 + max(vocabulary.values())
        self._space, self._feed, self._end = (np.zeros(size, bool) for _ in range(3))
        for token, i in vocabulary.items():
            self._space[i], self._feed[i], self._end[i] = token[0] == "\u0120", token[0] == "\u010a", token.endswith("</w>")

    def _cut(self, text: str) -> list[str]:
        if self._dropped:
            return text.replace("\n", " ").split(" ")
        spaced = text.replace("\n", " \n")
        if "  " in spaced or "\n\n" in text or spaced[-1:] in (" ", "\n"):  # runs of white space: the slower way
            return ["\0" + x for x in self._PIECES.findall(text)]
        first, *chunks = spaced.split(" ")
        return ["\0" + first, *chunks] if first else chunks

    @staticmethod
    def _meant(chunk: str) -> str:
        """A chunk is a word after a space, or begins with a line feed, or is literal after a mark."""
        return chunk[1:] if chunk[0] == "\0" else chunk if chunk[0] == "\n" else " " + chunk

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self._tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: set[str]) -> int:
        """New chunks; returns the characters of what is learned for them besides."""
        signed, mark = [], "" if self._dropped else "\0"
        for c in new:
            body = c.rstrip(self._SIGNS)
            # lower-cased, U+0130 ends in a mark, which is a pre-token with the signs
            if len(body) < len(c) and body[-1:] <= "\u017f" and body[-1:] != "\u0130" and body.lstrip("\0\n").isalpha():
                signed.append((c, body, mark + c[len(body) :]))
        parts = {x for _, *both in signed for x in both}.difference(self._cache)
        known = self._older.keys() & parts
        self._cache.update((c, self._older[c]) for c in known)
        if whole := new.difference([c for c, _, _ in signed]) | (parts - known):
            self._learn_whole(list(whole))
        get = self._cache.__getitem__
        self._cache.update((c, get(body) + get(signs)) for c, body, signs in signed)
        return sum(map(len, parts - new))

    def _learn_whole(self, new: list[str]) -> None:
        """Plain chunks are encoded as one text, which is cheaper for each, and told apart by their tokens."""
        plain = [c for c in new if c.isascii() and c.isalpha() or self._PLAIN.fullmatch(c)]
        words = [c for c in plain if c.isalpha()]
        plain = [c for c in plain if not c.isalpha()]
        if self._dropped:
            self._together(words, "\t".join(words).lower(), self._end, [1] * len(words))
            count = [1 if (m := self._WORD.fullmatch(c)) and not m[1] else 2 if m else len(self._pre_tokens(c.lower())) for c in plain]
            self._together(plain, "\t".join(self._pre_tokens(" ".join(plain).lower())), self._end, count)
        else:
            lines = [c for c in plain if c[0] == "\n"]
            plain = [c for c in plain if c[0] != "\n"]
            self._together(words, " " + "\t ".join(words), self._space)
            self._together(plain, "\t".join(self._pre_tokens(" " + " ".join(plain))), self._space)
            self._together(lines, "\t".join(self._pre_tokens("".join(lines))), self._feed)
        rest = [c for c in new if c not in self._cache]
        for chunk, enc in zip(rest, self._tok.encode_batch_fast(rest if self._dropped else [self._meant(c) for c in rest], add_special_tokens=False)):
            # other white space before a space may be one token with it: not a safe place to cut
            unsafe = not self._dropped and chunk[-1:].isspace() and self._meant(chunk).strip(" \n")
            self._cache[chunk] = None if unsafe else b"".join(i.to_bytes(4, "little") for i in enc.ids)

    def _together(self, chunks: list[str], parts: str, mark, count: list[int] | None = None) -> None:
        """Ids of the chunks, whose pre-tokens are ``parts``: each begins with a marked token or, by ``count``, ends with so many."""
        import numpy as np

        if not chunks:
            return
        letters, _ = self._decode(parts.encode(), "strict", self._letters)
        ids = np.asarray(self._model.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(mark[ids])
        if count is None:
            if len(at) != len(chunks) or at[0] != 0:
                return
            bounds = np.append(at, len(ids))
        else:
            if len(at) != sum(count) or min(count) < 1 or at[-1] != len(ids) - 1:
                return
            bounds = np.append(0, at[np.cumsum(count) - 1] + 1)
        raw, ends = ids.tobytes(), (4 * bounds).tolist()
        self._cache.update(zip(chunks, [raw[a:b] for a, b in zip(ends, ends[1:])]))

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. What is new in about a megabyte of texts is learned together."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= self.GROUP_CHARS:
                out += self._group(held)
                held, size = [], 0
        return out + self._group(held)

    def _group(self, texts: list[str]) -> list[bytes]:
        chunks = [self._cut(t) if self._dropped or "\0" not in t else ["\0\0"] for t in texts]
        if self._chars > self._limit:
            self._older, self._cache, self._chars = self._cache, {"\0\0": None}, 0
        missing = set().union(*chunks).difference(self._cache)
        if missing:
            known = self._older.keys() & missing
            self._cache.update((c, self._older[c]) for c in known)
            if len(known) < len(missing):
                self._chars += self._learn(missing - known)
            self._chars += sum(map(len, missing))
        get, out = self._cache.__getitem__, []
        for text, parts in zip(texts, chunks):
            try:
                out.append(b"".join(map(get, parts)))
            except TypeError:  # a chunk that is no safe place to cut
                out.append(self._whole(text))
        return out


def encoder(path: str, spaces: str) -> ChunkEncoder:
    """One encoder for each Python worker, which outlives its tasks."""
    return kept(("encoder", path, spaces), lambda: ChunkEncoder(path, spaces))
