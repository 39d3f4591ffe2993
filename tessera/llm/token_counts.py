"""Token counts by a sentencepiece BPE model, with a whole-token shortcut.

Proved beforehand from the vocabulary: the model leaves texts as they are but
for a leading space, no piece has a space after another character, and no piece
of several characters holds a line feed. So tokens never reach across the start
of a run of spaces nor a line feed, and the runs between are counted each on its
own. Vocabulary strings that the model encodes as one token by themselves count
one wherever they stand as such a run; only other runs are merged by the model.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import prepare

SPACE = "▁"
#: Runs whose counts a worker remembers, beside the proved ones.
REMEMBERED = 300_000
#: Characters taken at a time.
SLICE = 1 << 20
CUT, RUN = re.compile("(?<=[^ ]) "), re.compile(" +[^ ]*|[^ ]+")


@dataclass(frozen=True)
class Proof:
    """What holds for a model: whether runs are independent, and the words that
    after one space are one token."""

    path: str
    independent: bool
    words: frozenset[str] = field(hash=False)


def prove(path: str) -> Proof:
    """Check the conditions of the shortcut and test every vocabulary string."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = type(model.pieces[0])
    normal = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
    spec = model.normalizer_spec
    independent = (
        model.trainer_spec.model_type == model.trainer_spec.BPE and model.trainer_spec.byte_fallback
        and spec.name == "identity" and not spec.precompiled_charsmap
        and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        and not model.trainer_spec.treat_whitespace_as_suffix
        and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
        and not any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in normal))
    if not independent:
        return Proof(path, False, frozenset())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    words = [p[1:] for p in normal if p.startswith(SPACE) and SPACE not in p[1:]]
    alone = [w for w, ids in zip(words, sp.encode(words, num_threads=1)) if len(ids) == 1]
    # one space by itself: what precedes the first line feed of a text that starts with one
    return Proof(path, True, frozenset(alone) | ({""} if len(sp.encode("\n")) == 2 else frozenset()))


class TokenCounter:
    """Counts of whole texts. Keys are words after one space; other runs have a line feed before them."""

    def __init__(self, proof: Proof):
        self.proof = proof
        self.model = sentencepiece.SentencePieceProcessor(model_file=proof.path)
        self.feed = self.model.piece_to_id("<0x0A>")
        self.known = dict.fromkeys(proof.words, 1)

    def _runs(self, text: str):
        """The keys of a text's runs, in lists of bounded length."""
        text = " " + (text.replace(SPACE, " ") if SPACE in text else text)
        start = 0
        while start < len(text):
            cut = CUT.search(text, start + SLICE) if len(text) > start + SLICE else None
            end = cut.start() if cut else len(text)
            part = text[start:end]
            start = end
            keys: list[str] = []
            for line in part.split("\n"):
                if "  " in line:
                    keys += [r[1:] if r[0] == " " and r[1:2] != " " else "\n" + r for r in RUN.findall(line)]
                else:
                    words = line.split(" ")
                    if words[0]:
                        words[0] = "\n" + words[0]
                        keys += words
                    else:
                        keys += words[1:]
            yield keys, part.count("\n")

    def _learn(self, keys: list[str]) -> None:
        known = self.known
        new = list({k for k in keys if k not in known})
        if not new:
            return
        if len(known) + len(new) > REMEMBERED + len(self.proof.words):
            known = self.known = dict.fromkeys(self.proof.words, 1)
            new = list({k for k in keys if k not in known})
        ids = self.model.encode("".join(k if k[:1] == "\n" else "\n " + k for k in new))
        at = np.flatnonzero(np.array(ids) == self.feed)
        known.update(zip(new, (np.diff(at, append=len(ids)) - 1).tolist()))

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.proof.independent:
            return [len(self.model.encode(t)) if t else 0 for t in texts]
        out, group, held = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            for keys, feeds in self._runs(text) if text else ():
                out[k] += feeds
                group.append((k, keys))
                held += len(keys)
                if held > 100_000:
                    self._add(group, out)
                    group, held = [], 0
        self._add(group, out)
        return out

    def _add(self, group, out) -> None:
        self._learn(list(itertools.chain.from_iterable(keys for _, keys in group)))
        get = self.known.__getitem__
        for k, keys in group:
            out[k] += sum(map(get, keys))


@functools.lru_cache(maxsize=2)
def _counter(proof: Proof) -> TokenCounter:
    return TokenCounter(proof)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row's whole text.

    A null text counts as empty: no bytes, no tokens. Strings of special tokens
    inside a text are ordinary text, as the library has it by default. Null ids
    and repeated rows pass through; other columns are ignored. An empty table gives no
    rows, and a very long text is counted a slice at a time. ``model_path``
    must be there on every worker. Broadcast are at most the vocabulary's strings.
    """
    spark = prepare(docs.sparkSession)
    proof = spark.sparkContext.broadcast(prove(model_path))
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        counter = _counter(proof.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, n_bytes long, n_tokens long")


def count_documents(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    return token_counts(docs, model_path).withColumn("over_limit", F.col("n_tokens") > limit)
