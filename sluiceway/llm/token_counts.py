"""Token counts: unigram segmentation of pre-tokens that share their prefixes in a trie.

A pre-token is a run of characters between white space, with the word mark put in front. Distinct
pre-tokens go into a trie; every trie node holds the forward (best) score of its prefix and the
number of pieces on that best path, computed once however many pre-tokens share the prefix. The
node that ends a pre-token is its terminal count. A text's count is the sum over its pre-tokens.

The public vocabulary file carries merge ranks, not log probabilities; ranks become scores by
the Zipf-Mandelbrot law. Ties prefer the path with fewer pieces. Characters outside the
vocabulary fall back to one token a byte.

Defined results: null and blank texts count 0; rows are counted one by one, so repeated rows,
null ids and further columns change nothing; an empty table gives an empty result. Each worker's
trie is emptied when it has grown to ``max_nodes``: that bounds memory and changes no count.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.deploy import send_package

MARK = "▁"
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ZIPF_SHIFT = 2.7
MAX_NODES = 700_000


def load_pieces(path: str = DEFAULT_VOCABULARY) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with their log probability by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    norm = math.log(sum(1 / (rank + ZIPF_SHIFT) for rank in range(1, len(kept) + 1)))
    return {piece: -math.log(rank + ZIPF_SHIFT) - norm for rank, piece in enumerate(kept, 1)}


class PreTokenTrie:
    """Trie of pre-tokens; ``counts[pre_token]`` is its terminal count.

    A new pre-token walks the nodes it shares with earlier ones, whose forward scores stand, and
    extends the trie from there: pieces are walked in a trie of the vocabulary, and each piece that
    ends beyond the shared prefix offers its path to the node where it ends.
    """

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES):
        self.pieces: dict = {}
        for piece, score in pieces.items():
            state = self.pieces
            for char in piece:
                state = state.setdefault(char, {})
            state[None] = score
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min(pieces.values(), default=0.0) - 10.0
        self.max_nodes = max_nodes
        self.counts = _Terminals(self)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.forward: list[tuple[float, int]] = [(0.0, 0)]  # best score, minus the pieces on that path
        self.counts.clear()

    def count(self, pre_token: str) -> int:
        if len(self.children) > self.max_nodes:
            self.clear()
        children, forward = self.children, self.forward
        node, best = 0, [forward[0]]
        for char in pre_token:
            child = children[node].get(char)
            if child is None:
                break
            node = child
            best.append(forward[node])
        shared, size = len(best) - 1, len(pre_token)
        if shared == size:
            return -best[-1][1]
        best += [(float("-inf"), 0)] * (size - shared)
        for start in range(max(0, shared + 1 - self.longest), size):
            score, minus = best[start]
            if start >= shared:  # the character by its bytes
                n_bytes = len(pre_token[start].encode("utf-8", "surrogatepass"))
                offer = (score + n_bytes * self.byte_score, minus - n_bytes)
                if offer > best[start + 1]:
                    best[start + 1] = offer
            state, end, minus = self.pieces, start, minus - 1
            while end < size:
                state = state.get(pre_token[end])
                if state is None:
                    break
                end += 1
                if end > shared and (piece := state.get(None)) is not None:
                    offer = (score + piece, minus)
                    if offer > best[end]:
                        best[end] = offer
        for end in range(shared, size):
            children[node][pre_token[end]] = node = len(children)
            children.append({})
            forward.append(best[end + 1])
        return -best[size][1]


class _Terminals(dict):
    def __init__(self, trie: PreTokenTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        n = self.trie.count(MARK + word)
        if len(word) <= 64:  # longer ones aren't worth keeping
            if len(self) > self.trie.max_nodes:
                self.clear()
            self[word] = n
        return n


#: Tries of this worker process by the call they were made for; a worker serves many tasks.
_TRIES: dict[str, PreTokenTrie] = {}


def worker_trie(key: str, shipped, max_nodes: int) -> PreTokenTrie:
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = PreTokenTrie(shipped.value, max_nodes)
    return _TRIES[key]


def count_tokens(docs: DataFrame, pieces: dict[str, float] | None = None, vocabulary: str = DEFAULT_VOCABULARY,
                 max_nodes: int = MAX_NODES) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens; the vocabulary is read by the driver and broadcast (bounded by its file)."""
    send_package(docs.sparkSession)
    key, shipped = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary) if pieces is None else pieces)

    @F.pandas_udf("struct<n_pretokens: long, n_tokens: long>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookup = worker_trie(key, shipped, max_nodes).counts.__getitem__
        for texts in batches:
            found = [(len(w := (t or "").split()), sum(map(lookup, w))) for t in texts]
            yield pd.DataFrame(found, columns=["n_pretokens", "n_tokens"])

    both = docs.withColumn("__counted", counted(F.col("text").cast("string")))
    own = ("n_pretokens", "n_tokens")  # columns of these names give way
    return both.select(*[c for c in docs.columns if c not in own], *[f"__counted.{c}" for c in own])
