"""Subject areas of documents by class-association rules over sentences.

Sentences of training documents are transactions of words, word pairs and an area. Parallel
frequent-pattern growth mines rules "these terms -> area"; a rule is dropped if a part of its terms says
the same at least as surely. The first rules come from labelled documents and the areas' own titles and
descriptions; they then label the sentences of the training documents, those without a label too, and
rules are mined again. Held-out labelled documents calibrate what a rule's confidence is worth. Each
sentence of every document is then judged by the rules it matches, and a document has the areas that a
fifth of its sentences treat.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.textnorm import plain
from sightline.runtime import Staging

CLASS = "="
SENTENCES = 2_500
PRIOR = 20.0
ROUNDS = 2  # of labelling sentences by the rules so far and mining again
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_BLOCK_TAG = re.compile(r"</?(?:div|p|li|ul|ol|td|tr|table|h\d)\b[^<>]{0,200}>|<br\s*/?>\s*<br\s*/?>", re.I)
_HEADING = re.compile(r"(?m)^\s*(?:#{1,6}\s.*|[=_*~-]{3,}\s*|<h\d.*?</h\d>\s*)$")
_SENTENCE_END = re.compile(r"[.!?]+(?=[\s\"')\]}>*_]|$)|[。！？]+|\n\s*\n\s*|\n(?=\s*(?:[-*+>•]|\d+[.)]|\{|\d{4}-\d\d-\d\d|re:))", re.I)
_TERM = re.compile(r"[぀-ヿ㐀-䶿一-鿿]+|[^\W\d_぀-ヿ㐀-䶿一-鿿]+")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, without headings and code; numbers are no words, and two words are the
    least. Chinese gives pairs of neighbouring characters. Null, empty and junk texts have none."""
    if not text:
        return []
    text = _HEADING.sub("\n\n", _BLOCK_TAG.sub("\n\n", _FENCE.sub("\n\n", text.replace("\r\n", "\n"))))
    out = []
    for part in _SENTENCE_END.split(text):
        if not part or part.isspace():
            continue
        terms: list[str] = []
        for run in _TERM.findall(plain(part)):
            if run[0] >= "぀":
                terms.extend(run[i : i + 2] for i in range(len(run) - 1))
            else:
                terms.append(run)
        if len(terms) > 1:
            out.append(terms)
    return out


def items_of(terms: list[str]) -> set[str]:
    """Words of a sentence and pairs of neighbouring words."""
    return {*terms, *(f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False))}


@dataclass
class Rules:
    """``by_item``: rules (antecedent, area, confidence) filed under their first item, and the calibration."""

    by_item: dict[str, list[tuple[frozenset[str], str, float]]] = field(default_factory=dict)
    steps: list[tuple[float, float]] = field(default_factory=list)

    def worth(self, score: float) -> float:
        out = 0.0
        for at, value in self.steps:
            if score >= at:
                out = value
        return out

    def judge(self, terms: list[str]) -> tuple[str, float] | None:
        """The area with the most evidence, and the confidence of its best matching rule."""
        return _judge_items(self, items_of(terms))


TRAINING = "doc_id bigint, given array<string>, held boolean, sents array<array<string>>"


def _training_rows(df: DataFrame) -> DataFrame:
    """``doc_id, given, held, sents``: the labels of each document and the items of each of its sentences."""
    kinds = [("doc_id", pa.int64()), ("given", pa.list_(pa.string())), ("held", pa.bool_()), ("sents", pa.list_(pa.list_(pa.string())))]
    schema = pa.schema(kinds)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[sorted(items_of(s)) for s in sentences(text)] for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(items, kinds[3][1])], schema=schema)

    return df.select("doc_id", "given", "held", "text").mapInArrow(split, TRAINING)


def _labelled(training: DataFrame, rules: Rules, share: float) -> DataFrame:
    """``doc_id, labels, items`` of the sentences of documents whose areas are known; none in documents said to have none.

    Without rules a sentence has all labels of its document. With rules it has the area they judge it to
    treat; one that they do not judge has all areas they find in its document, or the labels it was given if
    they find none. Documents without a label or a found area are left out.
    """
    shared = training.sparkSession.sparkContext.broadcast(rules)
    schema = pa.schema([("doc_id", pa.int64()), ("labels", pa.list_(pa.string())), ("items", pa.list_(pa.string()))])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc, given, sents in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = [v[0] if (v := _judge_items(model, set(items))) and model.worth(v[1]) >= 0.5 else None for items in sents] if model.by_item else [None] * len(sents)
                counts = Counter(a for a in found if a)
                areas = sorted(a for a, n in counts.items() if n >= share * len(sents)) or [g for g in given or [] if g]
                if areas or given:
                    out.extend((doc, [area] if area in areas else areas if len(areas) < 3 else [], items) for area, items in zip(found, sents, strict=True))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return training.mapInArrow(label, "doc_id bigint, labels array<string>, items array<string>")


def _evidence(hits: int, total: int, base: float) -> float:
    """How much likelier so many hits are at their own rate than at the base rate, in nats."""
    miss = total - hits
    return hits * math.log(hits / total / base) + (miss * math.log(miss / total / max(1 - base, 1e-9)) if miss else 0.0)


def _prune(found: dict[frozenset[str], dict[str, int]], support: dict[frozenset[str], int], least_confidence: float, base: dict[str, float] | None = None, looked: int = 0) -> list[tuple[frozenset[str], str, float]]:
    """Rules whose smoothed confidence is high enough and above that of every rule with fewer of the same terms.

    With the ``base`` rates of areas a rule must also be less likely by chance than one in the ``looked`` at.
    """
    kept: dict[tuple[frozenset[str], str], float] = {}
    least = math.log(max(looked, len(support)) + 1)
    for antecedent in sorted(found, key=lambda a: (len(a), sorted(a))):
        for area, hits in found[antecedent].items():
            confidence = (hits + 0.2) / (support[antecedent] + 1.0)
            if confidence < least_confidence:
                continue
            if base is not None and (hits / support[antecedent] <= base[area] or _evidence(hits, support[antecedent], base[area]) < least):
                continue
            parts = [antecedent - {x} for x in antecedent] if len(antecedent) > 1 else []
            parts += [frozenset([x]) for x in antecedent] if len(antecedent) > 2 else []
            if all(confidence > kept.get((p, area), 0.0) + 0.01 for p in parts):
                kept[antecedent, area] = confidence
    return [(a, area, c) for (a, area), c in kept.items()]


def training_documents(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame, max_labelled: int = 20_000, least_training: int = 4_000) -> DataFrame:
    """``doc_id, given, held, text``: the documents that rules are mined from, and titles and descriptions of areas.

    At most ``max_labelled`` labelled documents, chosen by a hash of their id, so all that reaches the driver is
    bounded by that parameter; fewer than ``least_training`` are filled up by documents without a label, chosen
    likewise. Labels are compared in lower case without blanks; unknown ones are left out. A fifth of the
    documents with one label, by another hash, is held for the calibration. An area is a document with a
    negative id.
    """
    name = F.lower(F.trim("subject"))
    areas = subject_areas.filter("subject IS NOT NULL").select(name.alias("label"), "title", "description").distinct()
    named = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(name, F.lit("")).alias("label")).distinct()
    known = named.join(F.broadcast(areas.select("label").distinct().unionByName(labels.sparkSession.createDataFrame([("",)], "label string"))), "label")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = Staging(documents.sparkSession, "labelled").write(known.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("given")).orderBy(*by_hash).limit(max_labelled))
    held = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held")), F.lit(5)) == 0) & (F.size("given") == 1)
    texts = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = texts.join(chosen, "doc_id").select("doc_id", "given", held.alias("held"), "text")
    wanted = least_training - chosen.count()
    if wanted > 0:
        other = texts.select("doc_id").join(chosen, "doc_id", "left_anti").orderBy(*by_hash).limit(wanted)
        parts = parts.unionByName(texts.join(other, "doc_id").select("doc_id", F.array().cast("array<string>").alias("given"), F.lit(False).alias("held"), "text"))
    both = F.concat_ws(". ", "title", "description")
    said = areas.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.concat_ws(". ", both, both).alias("text")) for n in range(3)])).alias("d"))
    said = said.select((-F.abs(F.xxhash64("label", "d.n", "d.text"))).alias("doc_id"), F.array("label").alias("given"), F.lit(False).alias("held"), F.col("d.text").alias("text"))
    return parts.unionByName(said)


def learn_rules(
    documents: DataFrame, labels: DataFrame, subject_areas: DataFrame, items_per_sentence: int = 6, least_confidence: float = 0.55, share: float = 0.2, rounds: int = ROUNDS,
    max_labelled: int = 20_000, least_training: int = 4_000,
) -> Rules:
    """Rules mined from :func:`training_documents` in ``rounds`` rounds after the first, and their calibration.

    Of each sentence the ``items_per_sentence`` most telling items become a transaction. An item or rule must
    occur in one of ``SENTENCES`` sentences (twice at least, five times at most) and an item in two documents
    (three, of 500 or more).
    """
    staging = Staging(documents.sparkSession, "rules")
    chosen = training_documents(documents, labels, subject_areas, max_labelled, least_training)
    spread = min(64, max(4, documents.sparkSession.sparkContext.defaultParallelism))  # a bounded number of documents, from few files
    training = staging.write(_training_rows(chosen.repartition(spread, "doc_id")))
    rules = Rules()
    for _ in range(rounds + 1):
        rows = staging.write(_labelled(training.filter("NOT held"), rules, share))
        fresh = _mine(rows, staging, items_per_sentence, least_confidence)
        staging.drop(rows)
        if not fresh.by_item:
            break
        rules = fresh
        calibrate(rules, training.filter("held"))
    return rules


def _candidates(frequent: DataFrame, staging: Staging, size: int, least_confidence: float) -> tuple[dict[frozenset[str], dict[str, int]], dict[frozenset[str], int], dict[str, float], int]:
    """Hits of rules sure enough, by antecedent and area; support of their antecedents; rates of areas; antecedents looked at.

    Confidences are taken where the item sets are, so only rules that pass reach the driver.
    """
    def is_class(x):
        return F.startswith(x, F.lit(CLASS))

    sets = frequent.select(F.filter("items", is_class).alias("of"), F.array_sort(F.filter("items", lambda x: ~is_class(x))).alias("rest"), "freq").filter(F.size("of") <= 1)
    sets = staging.write(sets)
    whole = sets.filter((F.size("of") == 0) & (F.size("rest") > 0)).select("rest", F.col("freq").alias("total"))
    rules = sets.filter((F.size("of") == 1) & (F.size("rest") > 0)).join(whole, "rest").filter((F.col("freq") + 0.2) / (F.col("total") + 1.0) >= least_confidence)
    found: dict[frozenset[str], dict[str, int]] = {}
    support: dict[frozenset[str], int] = {}
    for r in rules.select("rest", F.col("of")[0].alias("area"), "freq", "total").collect():
        rest = frozenset(r["rest"])
        found.setdefault(rest, {})[r["area"][len(CLASS) :]], support[rest] = r["freq"], r["total"]
    base = {r["area"][len(CLASS) :]: r["freq"] / size for r in sets.filter((F.size("of") == 1) & (F.size("rest") == 0)).select(F.col("of")[0].alias("area"), "freq").collect()}
    looked = whole.count()
    staging.drop(sets)
    return found, support, base, looked


def _mine(rows: DataFrame, staging: Staging, items_per_sentence: int, least_confidence: float) -> Rules:
    size = rows.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    least_support, least_documents = min(5, max(2, -(-size[0] // SENTENCES))), 3 if size[1] >= 500 else 2
    # every sentence counts once for its item under the empty label, and once for each of its labels
    marked = rows.select("doc_id", F.explode("items").alias("item"), F.concat(F.array(F.lit("")), "labels").alias("labels"))
    counts = marked.select("doc_id", "item", F.explode("labels").alias("label")).groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))
    whole, named = F.col("label") == "", F.when(F.col("label") != "", F.col("n"))
    per_item = counts.groupBy("item").agg(F.max(F.when(whole, F.col("n"))).alias("all"), F.max(F.when(whole, F.col("docs"))).alias("docs"), F.max(named).alias("top"))
    per_item = per_item.filter((F.col("all") >= least_support) & (F.col("docs") >= least_documents))
    telling = {r["item"]: (r["top"] / (r["all"] + 1.0), r["all"]) for r in per_item.filter(F.col("top") >= 0.2 * F.col("all")).collect()}
    rules = Rules()
    if not telling:
        return rules
    shared = rows.sparkSession.sparkContext.broadcast(telling)
    schema = pa.schema([("basket", pa.list_(pa.string()))])

    def baskets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for labels, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best = sorted((i for i in items if i in shared.value), key=lambda i: (-shared.value[i][0], -shared.value[i][1], i))
                out.append([*best[:items_per_sentence], *(CLASS + a for a in labels)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], schema=schema)

    transactions = staging.write(rows.select("labels", "items").mapInArrow(baskets, "basket array<string>"))
    growth = FPGrowth(itemsCol="basket", minSupport=min(1.0, least_support / max(size[0], 1)), minConfidence=1.0).fit(transactions)
    found, support, base, looked = _candidates(growth.freqItemsets.filter(F.size("items") <= 4), staging, size[0], least_confidence)
    for antecedent, area, confidence in _prune(found, support, least_confidence, base, looked):
        rarest = min(antecedent, key=lambda i: (telling[i][1], i))
        rules.by_item.setdefault(rarest, []).append((antecedent, area, min(confidence, 0.999)))
    return rules


def calibrate(rules: Rules, held: DataFrame) -> None:
    """Steps from a rule's confidence to how often held-out sentences it judged had that label, made monotone.

    Only counts by bin reach the driver."""
    shared = held.sparkSession.sparkContext.broadcast(rules)
    schema = pa.schema([("bin", pa.int32()), ("right", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for given, sents in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                verdicts = [v for items in sents if (v := _judge_items(shared.value, set(items)))]
                out.extend((math.floor(score * 20), area == given[0]) for area, score in verdicts)
            columns = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    counts = held.mapInArrow(judge, "bin int, right boolean").groupBy("bin").agg(F.count_if("right").alias("hits"), F.count(F.lit(1)).alias("n"))
    bins = {r["bin"] / 20: (r["hits"], r["n"]) for r in counts.collect()}
    # a bin begins with sentences that bear its confidence out, so few held-out sentences do not outvote the rules
    blocks = [[at, hits + PRIOR * (at + 0.025), total + PRIOR] for at, (hits, total) in sorted(bins.items())]
    merged: list[list[float]] = []
    for block in blocks:  # pool neighbours that are out of order
        merged.append(block)
        while len(merged) > 1 and merged[-2][1] / merged[-2][2] > merged[-1][1] / merged[-1][2]:
            at, hits, total = merged.pop()
            merged[-1][1] += hits
            merged[-1][2] += total
    rules.steps = [(at, hits / total) for at, hits, total in merged] or [(0.0, 0.5)]
    if rules.steps[0][0] > 0.5:
        rules.steps.insert(0, (0.0, rules.steps[0][1]))


def _judge_items(rules: Rules, items: set[str]) -> tuple[str, float] | None:
    best: dict[str, float] = {}
    total: dict[str, float] = {}
    for item in items:
        for antecedent, area, confidence in rules.by_item.get(item, ()):
            if antecedent <= items:
                best[area] = max(best.get(area, 0.0), confidence)
                total[area] = total.get(area, 0.0) + math.log(confidence / (1 - confidence))
    if not best:
        return None
    area = max(total, key=lambda a: (total[a], a))
    return area, best[area]


def subject_evidence(documents: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", least_worth: float = 0.5) -> DataFrame:
    """``id, subject, n_treat, n_judged, n_sentences``: the sentences of every document that treat each area.

    One narrow pass over whole texts; the rules travel in a broadcast bounded by the labelled sample.
    Documents without a judged sentence have no row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(rules)
    names = [("id", pa.int64()), ("subject", pa.string()), ("n_treat", pa.int32()), ("n_judged", pa.int32()), ("n_sentences", pa.int32())]
    schema = pa.schema(names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = sentences(text)
                treat: dict[str, int] = {}
                for terms in parts:
                    verdict = model.judge(terms)
                    if verdict and model.worth(verdict[1]) >= least_worth:
                        treat[verdict[0]] = treat.get(verdict[0], 0) + 1
                judged = sum(treat.values())
                out.extend((doc, area, n, judged, len(parts)) for area, n in treat.items())
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "id bigint, subject string, n_treat int, n_judged int, n_sentences int").withColumnRenamed("id", id_col)


def assign_subjects(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame, share: float = 0.2) -> DataFrame:
    """``doc_id, subject`` for every area that at least ``share`` of a document's sentences treat.

    Null, empty and junk texts have no area; repeated documents or labels change nothing; without labels
    only what titles and descriptions tell is found. Other columns are ignored. ``subject_areas`` is the list of classes,
    read by the driver.
    """
    subjects = [r[0] for r in subject_areas.select("subject").filter("subject IS NOT NULL").distinct().collect()]
    lowered = {s.strip().lower(): s for s in subjects}
    rules = learn_rules(documents, labels, subject_areas, share=share)
    found = subject_evidence(documents, rules).filter(F.col("n_treat") >= share * F.col("n_sentences"))
    exact = F.create_map(*[F.lit(x) for pair in sorted(lowered.items()) for x in pair]) if lowered else F.create_map(F.lit(""), F.lit(""))
    return found.select("doc_id", exact[F.col("subject")].alias("subject")).filter("doc_id IS NOT NULL").distinct()
