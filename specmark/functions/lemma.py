"""Lemmas as a column (T3-T5), the only step of the marker stage that needs Python code.

An engine is opened once per worker and turns a batch of texts into one stream of (token, lemma) pairs for each text.
What becomes a marker is decided here, alike for every engine: alphabetic tokens give their lemma, or themselves where
the engine has none, in lower case. New engines are added by ``engine``.

``spacy`` and ``stanza`` need their package and French model on the executors, and ``stanza`` a GPU; ``identity``
takes each run of letters for its own lemma.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Pairs = Iterable[tuple[str, str | None]]
Engine = Callable[[list[str]], Iterable[Pairs]]

_OPENERS: dict[str, Callable[[int], Engine]] = {}


def engine(name: str):
    """Register what opens an engine, given the number of texts that it may take at once."""

    def register(opener: Callable[[int], Engine]) -> Callable[[int], Engine]:
        _OPENERS[name] = opener
        return opener

    return register


def opener_of(name: str) -> Callable[[int], Engine]:
    if name in _OPENERS:
        return _OPENERS[name]
    raise ValueError(f"no lemma engine {name!r} among {sorted(_OPENERS)}")


@engine("identity")
def _letters(at_once: int) -> Engine:
    runs = re.compile(r"[^\W\d_]+")
    return lambda texts: (((run, None) for run in runs.findall(text)) for text in texts)


@engine("spacy")
def _spacy(at_once: int) -> Engine:
    import spacy

    pipeline = spacy.load("fr_core_news_sm", disable=("parser", "ner"))
    return lambda texts: (((token.text, token.lemma_) for token in parsed) for parsed in pipeline.pipe(texts, batch_size=at_once))


@engine("stanza")
def _stanza(at_once: int) -> Engine:
    import stanza
    import torch

    if not torch.cuda.is_available():
        raise RuntimeError("stanza is run on a GPU only, and CUDA finds none")
    pipeline = stanza.Pipeline("fr", processors="tokenize,lemma", use_gpu=True, verbose=False)

    def read(texts: list[str]) -> Iterator[Pairs]:
        while texts:
            head, texts = texts[:at_once], texts[at_once:]
            yield from (((word.text, word.lemma) for word in parsed.iter_words()) for parsed in pipeline.bulk_process(head))

    return read


def lemmas_of(read: Engine, texts: list[str]) -> list[list[str]]:
    """The lemma markers of each text, in order, repeats kept."""
    return [[(lemma or token).lower() for token, lemma in pairs if token.isalpha()] for pairs in read(texts)]


#: Characters of texts that are taken from a batch at once, but for a longer text, so that a worker holds few lemmas.
CHARACTERS = 1 << 20


def _cuts(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Where runs of texts begin and end that have at most CHARACTERS together, or one text each."""
    start = held = 0
    for i, n in enumerate(lengths):
        if held + n > CHARACTERS and i > start:
            yield start, i
            start, held = i, 0
        held += n
    if lengths:
        yield start, len(lengths)


def lemma_batches(read: Engine, batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """The lemma markers of batches of texts, in as many arrays as it takes to keep each small; null has none."""
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch), 0).to_pylist()
        if not lengths:
            yield pa.array([], pa.list_(pa.string()))
        for start, end in _cuts(lengths):
            texts = [t or "" for t in batch.slice(start, end - start).to_pylist()]
            yield pa.array(lemmas_of(read, texts), pa.list_(pa.string()))


def lemmas(text: Column, name: str = "spacy", at_once: int = 256) -> Column:
    """The lemma markers of each text; null has none. An unknown name is refused at once."""
    opener = opener_of(name)

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lemma_batches(opener(at_once), batches)

    return run(text)
