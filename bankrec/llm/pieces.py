"""A SentencePiece BPE model: its pieces, and which of them may stand side by side.

Merging by score, leftmost first among equals, works on every run of neighbouring pieces
as if it stood alone. So a sequence of pieces is the encoding of its text exactly when each
two neighbours are the encoding of theirs, and every prefix of a text has one last piece.
The operators that count and encode build on that.
"""

from __future__ import annotations

from functools import cached_property

MARK = "▁"            # a space
NONE = -1                  # nothing, or a character without a piece, stands before
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or any(p.type in (_USER, _UNUSED) for p in proto.pieces):
            raise ValueError("a BPE model without user-defined and unused pieces is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (
                spec.add_dummy_prefix and spec.escape_whitespaces and proto.trainer_spec.byte_fallback):
            raise ValueError("a model that only marks spaces and falls back to bytes is needed")
        if any(MARK in p.piece.lstrip(MARK) for p in proto.pieces):
            raise ValueError("spaces within pieces are not supported")
        self.names = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.longest = max(map(len, self.ids))
        self.breaks_lines = not any("\n" in p for p in self.ids)
        self.known: dict[tuple[int, int], bool] = {}

    @cached_property
    def prefixes(self) -> set[str]:
        """Proper prefixes of pieces, the empty one too."""
        return {p[:n] for p in self.ids for n in range(len(p))}

    @cached_property
    def ends(self) -> dict[str, int]:
        """What pieces end with: the piece itself where it is one, else none. A text that is
        not here ends no piece, and nothing longer before the same place does."""
        return {p[n:]: NONE for p in self.ids for n in range(1, len(p))} | self.ids

    @cached_property
    def surfaces(self) -> list[bytes]:
        """What each piece stands for in decoded text."""
        out = []
        for name, kind in zip(self.names, self.kinds, strict=True):
            out.append(bytes([int(name[1:-1], 16)]) if kind == _BYTE else b"" if kind == _CONTROL
                       else " ⁇ ".encode() if kind == _UNKNOWN else name.replace(MARK, " ").encode())
        return out

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, the best score first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether ``piece`` may follow: the two are how their text is encoded."""
        key = (before, piece)
        known = self.known.get(key)
        if known is None:
            names = [self.names[piece]] if before == NONE else [self.names[before], self.names[piece]]
            if len(self.known) > 2_000_000:
                self.known.clear()
            known = self.known[key] = self.merged("".join(names)) == names
        return known
