"""Tokenising whole texts with a public tokenizer file, word by word from a memo.

The tokenizer's rules never look across a blank or a line break, so a text's
ids are those of its pieces between blanks, in order. Pieces repeat, and each
is encoded by the tokenizers library once for a worker. A text that holds
``<|``, which may start a control string, goes to the library as a whole.
"""

from __future__ import annotations

import os

END = "<|"
#: Pieces longer than this aren't remembered; so many pieces are at most.
LONGEST, MOST = 48, 1_000_000
AT_ONCE = 6_000_000  # bytes of text

_made: dict[str, "Memo"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Pieces, an Arrow array, with their ids, slices of one numpy array of self.kind.

    Pieces are looked up by Arrow, many texts at once. When there are more
    than `most`, those stay that were met again since the last time it was so,
    or none if they are over half; so memory is bounded and frequent pieces stay.
    """

    def __init__(self, path: str, most: int = MOST):
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.most = most
        self.pieces = pa.array([], pa.string())
        self.sizes, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, bool)
        mark = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # of ids that end a word
        self.last[[i for x, i in vocab.items() if x.endswith("</w>")]] = True

    def raw(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def many(self, pieces: list[str]) -> list[bytes]:
        """The pieces' ids, of one call each for words, for other pieces, and for the rest.

        A word is letters only and ends with the first id that ends a word.
        Digits are encoded one by one, so a 0 parts pieces that hold none.
        """
        import numpy as np

        out: list[bytes | None] = [None] * len(pieces)
        wide = self.kind.itemsize
        words = [i for i, x in enumerate(pieces) if len(x) <= LONGEST and x.isascii() and x.isalpha()]
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in words])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words):
                data, ends = ids.tobytes(), (ends * wide).tolist()
                for i, a, b in zip(words, [0, *ends], ends):
                    out[i] = data[a:b]
        plain = [i for i, x in enumerate(pieces) if out[i] is None and self.mark is not None and len(x) <= LONGEST and "0" not in x]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" 0 ".join([pieces[i] for i in plain])], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(ids == self.mark)
            data = ids.tobytes()
            for i, a, b in zip(plain, [0, *((at + 1) * wide).tolist()], [*(at * wide).tolist(), len(data)], strict=True):
                out[i] = data[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = np.array(x.ids, self.kind).tobytes()
        return out

    def remember(self, pieces, sizes, ids) -> None:
        """Add these new pieces, but for long ones; make room first if there is none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        short = pc.less_equal(pc.utf8_length(pieces), LONGEST).to_numpy(zero_copy_only=False)
        if len(self.pieces) + int(short.sum()) > self.most:
            kept = self.used if 2 * int(self.used.sum()) <= self.most else np.zeros(len(self.used), bool)
            self.ids, self.sizes, self.pieces = self.ids[np.repeat(kept, self.sizes)], self.sizes[kept], self.pieces.filter(pa.array(kept))
            self.used = np.zeros(len(self.sizes), bool)
        if len(self.pieces) + int(short.sum()) > self.most:
            return
        self.pieces = pa.concat_arrays([self.pieces, pieces.filter(pa.array(short))])
        self.ids, self.sizes = np.concatenate([self.ids, ids[np.repeat(short, sizes)]]), np.concatenate([self.sizes, sizes[short]])
        self.used = np.concatenate([self.used, np.zeros(int(short.sum()), bool)])

    def encode_all(self, texts) -> list[bytes]:
        """The ids of whole texts, an Arrow array or list of strings; none for null and the empty text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
        out, lo = [], 0
        while lo < len(texts):
            hi = max(lo + 1, int(ends.searchsorted((ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
            out += self._encode(texts.slice(lo, hi - lo))
            lo = hi
        return out

    def _encode(self, texts) -> list[bytes]:
        """Split, look up and join the pieces in Arrow and numpy; only new pieces become Python strings."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pc.fill_null(pc.match_substring(texts, END), False)
        # as the tokenizer does, A-Z are lowered, and a full stop or comma after a letter is encoded apart
        plain = pc.ascii_lower(pc.replace_substring(pc.if_else(whole, "", pc.fill_null(texts, "")), "\n", " "))
        plain = pc.replace_substring_regex(plain, "([a-z])([.,]) ", "\\1 \\2 ")
        lists = pc.split_pattern(plain, " ")
        flat = lists.flatten()
        found = pc.index_in(flat, value_set=self.pieces)
        at = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        open_ = flat.filter(pc.is_null(found))
        new = open_.unique()
        ids, sizes = self.ids, self.sizes
        self.used[at[at >= 0]] = True
        if len(new):
            at[at < 0] = len(sizes) + pc.index_in(open_, value_set=new).to_numpy()
            made = self.many(new.to_pylist())
            more = np.frombuffer(b"".join(made), self.kind)
            size = np.fromiter(map(len, made), np.int64, len(made)) // self.kind.itemsize
            ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, size])
            self.remember(new, size, more)
        n = sizes[at]
        stops = n.cumsum()
        first = (sizes.cumsum() - sizes)[at] - (stops - n)  # of a piece in ids, less its place in the result
        data = memoryview(ids[np.repeat(first, n) + np.arange(n.sum())].tobytes())
        cut = (np.concatenate([[0], stops])[np.asarray(lists.offsets) - lists.offsets[0].as_py()] * self.kind.itemsize).tolist()
        out = [bytes(data[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.raw(texts[i].as_py())
        return out


def memo(path: str) -> Memo:
    """This worker's memo; one tokenizer at a time."""
    if path not in _made:
        _made.clear()
        _made[path] = Memo(path)
    return _made[path]
