"""Token ids of texts by a public tokenizer, with a bounded cache of the pieces that it cuts texts into."""

import os
import re

import numpy as np

#: Texts of these characters only are cut here as the pre-tokenizer cuts them: ASCII, and letters from U+00C0 to U+024F
#: that lower-casing leaves single. The separators 1C to 1F are white space to some and not to others.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]*")
#: Their pieces: endings of contractions, runs of letters, of digits (one by one where `spaced` is false) and of other marks,
#: with the space before them or without white space.
_ENDINGS = rb"'(?:s|t|re|ve|m|ll|d)"
_SPACED = re.compile(_ENDINGS + rb"| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\x20\x09-\x0DA-Za-z0-9\x80-\xff]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
_BARE = re.compile(_ENDINGS + rb"|[A-Za-z\x80-\xff]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9\x80-\xff]+")
#: White space outside ASCII and separators that some definitions count as white space; texts with any are encoded whole.
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Other texts are cut at white space: a word with the space before it, the white space before that, and the rest.
_WIDE = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?=[\x20\x09-\x0D][^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
_coders: dict[tuple, "Coder"] = {}


def _byte_letters() -> list[str]:
    """What byte-level models write for each byte: visible Latin-1 characters as they are, the others from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in seen else chr(0x100 + next(rest)) for b in range(256)]


class Coder:
    """Encodes texts as the tokenizer in `path` does, adding no special tokens.

    A text that contains one of the tokenizer's added tokens, in any case, goes to the whole tokenizer.
    The ids of a text are those of its pieces, which are looked up. Pieces of plain texts are those of the
    pre-tokenizer, so a new one goes straight to the tokenizer's model; other texts are cut at white space,
    where every pre-tokenizer cuts, and a new piece goes to the whole tokenizer. The cache holds about
    `most` pieces; when full it becomes the old one, from which pieces in use come back. Pieces of more
    than `long` bytes are not kept. spaced: whether the tokenizer keeps white space; if not, it is taken
    to lower-case.
    """

    def __init__(self, path: str, spaced: bool, most: int = 400_000, long: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.heads = {next((c for c in a if c == c.lower() == c.upper()), "") for a in added}  # a character that has no case
        self.split = self.tokenizer.model.tokenize
        self.spaced, self.letters = spaced, dict(enumerate(_byte_letters()))
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.most, self.long = most, long
        self.fine: tuple[dict, dict] = {}, {}
        self.wide: tuple[dict, dict] = {}, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _token(self, piece: bytes) -> bytes:
        """The ids of a pre-token, which the model takes in its byte letters."""
        of = self.bytes_of
        return b"".join([of[t.id] for t in self.split(piece.decode("latin-1").translate(self.letters))])

    def _wide_piece(self, piece: bytes) -> bytes:
        return self._whole(piece.decode())

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; none for null or empty text."""
        if not text:
            return b""
        if any(h in text for h in self.heads) and self.added.search(text):
            return self._whole(text)
        if _PLAIN.fullmatch(text):
            pieces = _SPACED.findall(text.encode()) if self.spaced else _BARE.findall(text.lower().encode())
            self.fine, out = self._looked_up(pieces, *self.fine, self._token)
            return out
        if _OTHER.search(text):
            return self._whole(text)
        pieces = _WIDE.findall(text.encode()) if self.spaced else text.encode().split()
        self.wide, out = self._looked_up(pieces, *self.wide, self._wide_piece)
        return out

    def _looked_up(self, pieces: list[bytes], cache: dict, old: dict, make) -> tuple[tuple[dict, dict], bytes]:
        parts = [*map(cache.get, pieces)]
        if None in parts:
            at = -1
            try:
                while True:
                    at = parts.index(None, at + 1)
                    piece = pieces[at]
                    found = cache.get(piece) or old.get(piece) or make(piece)
                    if len(piece) <= self.long:
                        cache[piece] = found
                    parts[at] = found
            except ValueError:  # no more
                pass
            if len(cache) > self.most:
                return ({}, cache), b"".join(parts)
        return (cache, old), b"".join(parts)


def coder(path: str, spaced: bool) -> Coder:
    """One coder for each tokenizer and worker process."""
    if (path, spaced) not in _coders:
        _coders[path, spaced] = Coder(path, spaced)
    return _coders[path, spaced]
