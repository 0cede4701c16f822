"""Token counts under a unigram segmentation, scored once per shared prefix of a trie.

Texts are cut at blanks into pre-tokens, each with the marker for a word's
start in front. The distinct pre-tokens of a batch enter a trie. The node for a
prefix holds its forward score: the best sum of piece scores over all ways to
cut the prefix into pieces, and the number of pieces in that cut. Pre-tokens
with a common prefix share its nodes, so its scores are computed once; the
count at the node where a pre-token ends is the pre-token's. A character in no
piece costs one token for each of its UTF-8 bytes.

Pieces and ranks come from a public vocabulary file whose path is a parameter;
a piece of rank ``r`` scores ``-log(r + 2)``, the rank-frequency law. Ties go to
fewer tokens, then to the longer last piece.

Every Python worker keeps a trie from task to task and clears it beyond
``max_nodes`` (and the terminal counts beyond twice as many), which costs work
and changes nothing; counts need no shuffle. Texts without blanks enter the trie
like words; only a pre-token longer than ``trie_chars``, which would fill the trie
by itself, is scored along an array instead, by the same recurrence.

Defined cases: null, empty and blank texts have no tokens; repeated rows get
equal counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trawlkit.llm.common import frugal

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_BYTE_SCORE = -20.0


def read_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> score of a sentencepiece model's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    # single characters close the file; their own scores order the pieces
    ordinary.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(ordinary)}


class TrieCounter:
    def __init__(self, pieces: dict[str, float], max_nodes: int = 500_000, trie_chars: int = 1 << 14):
        self.pieces, self.max_nodes, self.trie_chars = pieces, max_nodes, trie_chars
        self.longest = max(map(len, pieces), default=1)
        #: pieces by their last character backwards: {char: {...}}, "" holds the score
        self.back: dict = {}
        for piece, score in pieces.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.scored = 0  #: nodes computed so far
        self.terminal: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        #: a node: (children, score, tokens, parent, character)
        self.root = ({}, 0.0, 0, None, "")
        self.nodes = 1

    def _node(self, parent, char: str):
        """The forward score of the parent's prefix and ``char``, from those of its own prefixes."""
        n_bytes = len(char.encode("utf-8", "surrogatepass"))
        best, tokens = parent[1] + _BYTE_SCORE * n_bytes, parent[2] + n_bytes
        piece, before, c = self.back, parent, char
        while (piece := piece.get(c)) is not None:
            s = piece.get("")
            if s is not None:
                s += before[1]
                n = before[2] + 1
                if s > best or s == best and n <= tokens:
                    best, tokens = s, n
            c, before = before[4], before[3]
            if before is None:
                break
        node = ({}, best, tokens, parent, char)
        parent[0][char] = node
        self.nodes += 1
        self.scored += 1
        return node

    def _array(self, word: str) -> int:
        best, tokens = [0.0], [0]
        for end in range(1, len(word) + 1):
            n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
            s, t = best[-1] + _BYTE_SCORE * n_bytes, tokens[-1] + n_bytes
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                p = self.pieces.get(word[start:end])
                if p is not None and (best[start] + p > s or best[start] + p == s and tokens[start] + 1 <= t):
                    s, t = best[start] + p, tokens[start] + 1
            best.append(s)
            tokens.append(t)
        return tokens[-1]

    def tokens(self, pre_token: str) -> int:
        found = self.terminal.get(pre_token)
        if found is None:
            word = MARK + pre_token
            if len(word) > self.trie_chars:
                return self._array(word)
            if self.nodes > self.max_nodes:
                self.clear()
            if len(self.terminal) > 2 * self.max_nodes:
                self.terminal.clear()
            node = self.root
            for c in word:
                node = node[0].get(c) or self._node(node, c)
            found = self.terminal[pre_token] = node[2]
        return found

    def count(self, text: str | None) -> tuple[int, int]:
        """(tokens, pre-tokens) of a text."""
        words = text.split() if text else []
        known, get = self.terminal, self.tokens
        if len(words) < 4_000:
            return sum([known.get(w) or get(w) for w in words]), len(words)
        return sum(n * get(w) for w, n in Counter(words).items()), len(words)


#: A Python worker's trie, kept from task to task.
_kept: dict[tuple, TrieCounter] = {}


def _counter(key: tuple, pieces) -> TrieCounter:
    if key not in _kept:
        _kept.clear()
        _kept[key] = TrieCounter(pieces.value, key[1])
    return _kept[key]


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY, text: str = "text", max_nodes: int = 500_000) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary))  # one vocabulary, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter((vocabulary, max_nodes), pieces)
        for batch in batches:
            found = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], type=pa.int64()), pa.array([n for n, _ in found], type=pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", text).mapInArrow(frugal(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_pretokens long, n_tokens long")
