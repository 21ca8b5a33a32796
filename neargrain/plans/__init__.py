"""The classifier as a plan: from a corpus to macro-F1, at once or step by step."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.operators import counts, evaluate, index, knn, rank, split, weights
from neargrain.sources import cut, load, save
from neargrain.sources.state import StaleState, drop_manifest, fingerprint, read_manifest, write_manifest

#: The steps in order, and the tables of each that later steps start from.
STEPS = {"prune": ("postings", "doc_labels"), "weigh": ("weighted",), "split": ("chosen",), "search": ("entries",), "rank": ("ranks",), "evaluate": ("cells", "score")}

#: The settings that each step's tables depend on, besides those of the steps before it.
SETTINGS_OF = {
    "prune": ("labels_below", "labels_above", "words_below", "words_above", "frequent_words", "common_words"),
    "weigh": ("weighting", "narrow"),
    "split": ("prop", "split"),
    "search": ("k", "candidates", "norm", "overlap", "gate", "digits", "queries"),
    "rank": ("per_occurrence", "w"),
    "evaluate": ("alpha",),
}


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; None leaves a step out."""

    labels_below: int = 3
    labels_above: float = 1.0
    words_below: int | None = 3
    words_above: float = 1.0
    frequent_words: float | None = 0.4  # ceiling on document frequencies, of all (document, word) pairs, in a second pass
    common_words: float | None = None  # the same, of all documents: removes words that make the join on words large
    weighting: str = "tf_idf"  # or "raw"
    narrow: bool = False
    prop: float = 0.1
    split: str = "tail"
    k: int = 70
    candidates: str = "all"
    search: str = "join"  # or "bounds", "overlap", "blocks": see knn.SEARCHES
    norm: str = "l2"
    overlap: float | None = None
    gate: bool = False
    digits: int = 6
    per_occurrence: bool = False
    w: tuple[float, float, float, float] = rank.WEIGHTS
    alpha: float = rank.ALPHA
    queries: int = -1  # validation documents to score, in order; -1: all


@dataclass(frozen=True)
class Run:
    """Every table of a run, made when asked for. Tables that several later steps use are written
    once, so that no step's plan holds those of all steps before it."""

    corpus: tuple[DataFrame, DataFrame]  # postings, doc_labels
    edges: DataFrame
    settings: Settings = Settings()
    origin: str = ""  # how the corpus was read, where its files alone don't tell

    @cached_property
    def second_pass(self) -> tuple[DataFrame, DataFrame] | None:
        """The corpus before the last pruning pass, written once; None where there is one pass."""
        s = self.settings
        if s.words_below is None:
            return None
        postings, labels = (cut(x) for x in self.corpus)
        keep = counts.prune(counts.label_counts(labels), counts.label_totals(labels), s.labels_below, s.labels_above)
        words = counts.prune(counts.word_counts(postings), counts.word_totals(postings), s.words_below, s.words_above)
        return tuple(cut(x) for x in counts.prune_corpus(postings, labels, keep, words))

    @cached_property
    def aligned(self) -> tuple[DataFrame, DataFrame]:
        """Both pruned tables as plans."""
        s = self.settings
        postings, labels = self.second_pass or counts.prune_corpus(*self.corpus)
        for ceiling, total in ((s.frequent_words, counts.word_totals), (s.common_words, counts.document_total)):
            if ceiling is not None:
                words = counts.prune(counts.word_counts(postings, True), total(postings), 0, ceiling)
                postings, labels = counts.prune_corpus(postings, labels, None, words)
        return postings, labels

    @cached_property
    def postings(self) -> DataFrame:
        return cut(self.aligned[0])

    @cached_property
    def doc_labels(self) -> DataFrame:
        # Documents that have both a label and a word left are those of the written postings.
        return cut(self.aligned[1].join(self.postings.select("doc_id").distinct(), "doc_id", "left_semi"))

    @property
    def pruned(self) -> tuple[DataFrame, DataFrame]:
        """Both tables, written; a step that asks for one of them doesn't make the other."""
        return self.postings, self.doc_labels

    @cached_property
    def weighted(self) -> DataFrame:
        return weights.raw_weights(self.postings) if self.settings.weighting == "raw" else cut(weights.weights(self.postings, self.settings.narrow))

    @cached_property
    def chosen(self) -> DataFrame:
        return cut(split.split_prop(self.doc_labels, self.settings.prop, self.settings.split))

    @cached_property
    def validation(self) -> DataFrame:
        return self.chosen if self.settings.queries < 0 else self.chosen.orderBy("doc_id").limit(self.settings.queries)

    @cached_property
    def parts(self) -> dict[str, DataFrame]:
        train_w, _ = split.separate(self.weighted, self.chosen)
        train_l, _ = split.separate(self.doc_labels, self.chosen)
        query_w = cut(split.separate(self.weighted, self.validation)[1])  # a small part, used several times
        _, query_l = split.separate(self.doc_labels, self.validation)
        return {"train": train_w, "train_labels": train_l, "queries": query_w, "query_labels": query_l}

    @cached_property
    def label_counts(self) -> DataFrame:
        return counts.label_counts(self.doc_labels)

    @cached_property
    def entries(self) -> DataFrame:
        s, p = self.settings, self.parts
        # Not written: ranks are made where a query's entries lie together.
        return knn.top_k(p["queries"], p["train"], p["train_labels"], s.k, s.candidates, norm=s.norm, overlap=s.overlap, gate=s.gate, digits=s.digits, search=s.search)

    @cached_property
    def features(self) -> DataFrame:
        return rank.label_features(self.entries, index.parent_sums(self.edges, self.doc_labels), self.label_counts, self.settings.per_occurrence)

    @cached_property
    def ranks(self) -> DataFrame:
        # Not written either: every later table is made from them in one pass.
        return rank.ranks(self.features, self.settings.w)

    @cached_property
    def predicted(self) -> DataFrame:
        return rank.predict(self.ranks, self.settings.alpha)

    @cached_property
    def predicted_with_fallback(self) -> DataFrame:
        return rank.predict_or_common(self.ranks, self.parts["queries"], self.label_counts, self.settings.alpha)

    @cached_property
    def truth(self) -> DataFrame:
        return self.parts["query_labels"].select(F.col("doc_id").alias("q"), "label")

    @cached_property
    def cells(self) -> DataFrame:
        return cut(evaluate.confusion(self.predicted_with_fallback, self.truth))

    @cached_property
    def score(self) -> DataFrame:
        return evaluate.macro(self.cells)

    def _state(self, name: str) -> dict:
        """What a step's tables depend on."""
        names = list(STEPS)
        fields = [f for step in names[: names.index(name) + 1] for f in SETTINGS_OF[step]]
        settings = {f: v for f, v in asdict(self.settings).items() if f in fields}
        return json.loads(json.dumps({"settings": settings, "inputs": self._inputs}))

    @cached_property
    def _inputs(self) -> list[str]:
        return [self.origin, *map(fingerprint, (*self.corpus, self.edges))]

    def steps(self, folder: str, first: str = "prune", last: str = "evaluate") -> None:
        """Makes the steps from ``first`` to ``last``: the tables of earlier ones are read from
        ``folder``, where an earlier call has put them, and each step's are written there.

        A step's folder has a manifest, which is removed before its tables are written and written
        after them: with the step's settings and those before it, fingerprints of the inputs, and the
        manifest of the step before, by which tables of different runs are told apart. Earlier
        steps that are incomplete, or differ in any of these, raise ``StaleState``.
        """
        spark, names, before = self.edges.sparkSession, list(STEPS), None
        a, b = names.index(first), names.index(last)
        for name in names[:a]:
            found = read_manifest(spark, f"{folder}/{name}")
            if found is None:
                raise StaleState(f"step {name} isn't complete in {folder}")
            if found["after"] != before:
                raise StaleState(f"step {name} in {folder} follows another run of the step before it")
            state = self._state(name)
            if changed := [f for f, v in state["settings"].items() if found["settings"].get(f) != v]:
                raise StaleState(f"step {name} in {folder} was made with other settings: {changed}")
            if found["inputs"] != state["inputs"]:
                raise StaleState(f"step {name} in {folder} was made from other inputs")
            before = found["id"]
            self.__dict__.update(load(spark, f"{folder}/{name}", STEPS[name]))
        for name in names[a : b + 1]:
            drop_manifest(spark, f"{folder}/{name}")
            save({t: getattr(self, t) for t in STEPS[name]}, f"{folder}/{name}")
            own = uuid.uuid4().hex
            write_manifest(spark, f"{folder}/{name}", self._state(name) | {"step": name, "id": own, "after": before})
            before = own
            self.__dict__.update(load(spark, f"{folder}/{name}", STEPS[name]))
