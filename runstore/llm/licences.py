"""Licence scans by sentence rules.

A text is cut into paragraphs and sentences, each is normalised with its line ends, and known licence
sentences map to an identifier. They begin with a line and may wrap over several. Other lines that only look like licence talk become ``UNKNOWN``. The sequence of
identifiers of a document is then read from left to right against an ordered list of rules: at
each place the first rule whose sequence matches consumes it and names a licence. Identifiers
that no rule uses are counted as unmatched.

A rule may consume sentences that name no licence of their own, such as a warranty.

Rules and sentences are parameters; the tables of ``licence_table`` are the defaults.

Nulls and odd input: a null or empty text has no licence (``licences`` is the empty string). A very
long text is scanned whole. Repeated rows give repeated results; ties do not arise, since rule order
decides. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_table import RULES, SENTENCES, TRIGGERS
from .scratch import bounded
from .textkit import tidy

# Comment marks and list numbers before a line's words; a blank line between paragraphs, except before
# an address; the end of a sentence, which no abbreviation and no clause of a known sentence is.
_LEAD = re.compile(r"^[^\S\n]*(?:[#*/;>|%!\-]+[^\S\n]*|\.\.[^\S\n]+|dnl[^\S\n]+)*(?:(?:\(?\d{1,2}|\([abd-z]|[a-z])\)[^\S\n]+)?", re.M)
_BREAK = re.compile(r"\n[^\S\n]*\n\s*+(?!<?https?:)")
_CUT = re.compile(r"(?<=[.!?;])(?<![\s(][vV]\.)(?<![eE]\.g\.)(?<![iI]\.e\.)\s+(?!(?i:either\s+version|you\s+can\s+redistribute)\b)")
_MARKS = re.compile(r"^[\s*#/\-;>|\"']+|[\s.!?;*#/|\"']+$")
_GAP = r"\s"
_TALK = re.compile(r"\blicen[sc]ed?\b|\bcopyright\b|\brights reserved\b|\bspdx\b")


def normalise(sentence: str) -> str:
    """Lower case, one space or line end between words, licence spelt with s, no comment marks or end marks."""
    sentence = re.sub(r"[^\S\n]+", " ", re.sub(r"\s*\n\s*", "\n", sentence)).strip().lower().replace("licence", "license").replace("licenced", "licensed")
    return _MARKS.sub("", sentence)


@dataclass(frozen=True)
class Recogniser:
    sentences: tuple[tuple[str, str], ...] = SENTENCES
    rules: tuple[tuple[tuple[str, ...], str], ...] = RULES
    triggers: tuple[str, ...] = TRIGGERS
    _compiled: dict = field(default_factory=dict, compare=False)

    def _table(self, what: str) -> list:
        if what not in self._compiled:
            self._compiled[what] = [(re.compile(f"(?:{p.replace(' ', _GAP)})(?=[\\s.!?;:,*#/|\"']*(?:\\n|\\Z))", re.S), i) for p, i in self.sentences] if what == "sentences" else [([re.compile(p) for p in ps], i) for ps, i in self.rules] if what == "rules" else re.compile("|".join(re.escape(x).replace("\\ ", r"[\s*#/;>|%!\-]+") for x in self.triggers))
        return self._compiled[what]

    def __getstate__(self):
        return {"sentences": self.sentences, "rules": self.rules, "triggers": self.triggers, "_compiled": {}}

    def __setstate__(self, state):
        for k, v in state.items():
            object.__setattr__(self, k, v)

    def identify(self, sentence: str) -> list[str]:
        """Identifiers of a normalised sentence: of the known ones that begin with its lines, and
        ``UNKNOWN`` for each other line of licence talk."""
        out, at = [], 0
        while at < len(sentence):
            for pattern, name in self._table("sentences"):
                if m := pattern.match(sentence, at):
                    out.append(name.format(**{k: re.sub(r"\s", " ", v or "") for k, v in m.groupdict().items()}))
                    at = m.end()
                    break
            else:
                end = sentence.find("\n", at)
                end = len(sentence) if end < 0 else end
                if _TALK.search(sentence, at, end):
                    out.append("UNKNOWN")
                at = end
            end = sentence.find("\n", at)
            at = len(sentence) if end < 0 else end + 1
        return out

    def sequence(self, text: str | None) -> list[str]:
        """The identifiers of a text's sentences, in order."""
        trigger = self._table("triggers")
        if not text or not trigger.search(text.lower().replace("licence", "license")):
            return []
        out = []
        for paragraph in _BREAK.split(_LEAD.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))):
            for sentence in _CUT.split(paragraph):
                if trigger.search(low := sentence.lower()) or "licence" in low:
                    out += self.identify(normalise(sentence))
        return out

    def match(self, ids: list[str]) -> tuple[list[str], int]:
        """Licences in order of first place, and the number of identifiers that no rule used."""
        found, unmatched, i = [], 0, 0
        while i < len(ids):
            for patterns, name in self._table("rules"):
                hits = [p.fullmatch(x) for p, x in zip(patterns, ids[i : i + len(patterns)])]
                if len(hits) == len(patterns) and all(hits):
                    parts = [g for h in hits for g in h.groups()]
                    named = re.sub(r"\{(\d)\}", lambda m: parts[int(m[1]) - 1], name)
                    found += [named.upper() if name.startswith("CC") else named] * bool(named)
                    i += len(patterns)
                    break
            else:
                unmatched += 1
                i += 1
        return list(dict.fromkeys(found)), unmatched


def scan(docs: DataFrame, recogniser: Recogniser = Recogniser()) -> DataFrame:
    """``doc_id, licences, sentences, n_unmatched`` for every row of ``docs`` (doc_id, text).

    ``licences`` holds the names joined by `` AND ``; ``sentences`` the identifiers by a blank.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, left = [], [], []
            for text in batch.column("text").to_pylist():
                sequence = recogniser.sequence(text)
                found, unmatched = recogniser.match(sequence)
                names.append(" AND ".join(found))
                ids.append(" ".join(x.replace(" ", "") for x in sequence))
                left.append(unmatched)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(ids, pa.string()), pa.array(left, pa.int64())], names=["doc_id", "licences", "sentences", "n_unmatched"])

    docs = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return docs.mapInArrow(run, "doc_id long, licences string, sentences string, n_unmatched long")
