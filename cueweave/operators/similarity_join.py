"""Similarity joins between the texts of two tracks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions import similarity as sim
from cueweave.functions.text import norm_text
from cueweave.operators.matching import best_per_reference, match_serial
from cueweave.operators.timing import even_sample
from cueweave.plans.lineage import cut_lineage


def profiled(cues: DataFrame, text: str, out: str) -> DataFrame:
    """Add the profile struct ``out`` of the normalised ``text`` of each row."""
    return sim.with_profile(cues.withColumn("_norm", norm_text(F.col(text))), "_norm", out).drop("_norm")


def pair_scores(pairs: DataFrame, p: str, q: str, names: tuple[str, ...] = tuple(sim.WEIGHTS)) -> DataFrame:
    """Add one ``s_<name>`` column per score for the profile columns ``p`` and ``q``."""
    return pairs.withColumns({f"s_{n}": sim.score(n, F.col(p), F.col(q)) for n in names})


def total_score(weights: dict[str, float] = sim.WEIGHTS) -> Column:
    return sim.weighted({n: F.col(f"s_{n}") for n in weights}, weights)


def scores_above(pairs: DataFrame, p: str, q: str, min_score: float | Column, scorers: tuple[sim.Scorer, ...] | None = None) -> DataFrame:
    """``s_<name>`` of every scorer, of the pairs whose weighted sum is >= ``min_score``; the cheapest score first.

    Each stage keeps the pairs that the declared bounds of the remaining scores
    could still lift to the threshold, so nothing is lost whatever the scorers
    are. The six scores with their usual weights are the default.
    """
    scorers = sim.scorers() if scorers is None else scorers
    x, y, limit = F.col(p), F.col(q), min_score - 1e-9

    def at_most(done: list[sim.Scorer], but: sim.Scorer | None = None) -> Column:
        """What the sum can be, with the scores done and the bounds of the others (``but`` counts as 0)."""
        parts = [k.weight * (F.col(f"s_{k.name}") if k in done else F.lit(1.0) if k.bound is None else F.col(f"_u_{k.name}")) for k in scorers if k != but]
        return sum(parts[1:], parts[0]) if parts else F.lit(0.0)

    bounds = [k.bound(x, y).alias(f"_u_{k.name}") for k in scorers if k.bound]
    # Pushed into the join that makes the pairs, the bounds would become a method too long for the JIT compiler.
    found = pairs.select("*", F.inline_outer(interpreted(F.struct(*bounds)))) if bounds else pairs
    done: list[sim.Scorer] = []
    for k in sorted(scorers, key=lambda k: k.cost):
        hopeful = at_most(done) >= limit
        if k.above and k.weight > 0:
            score = k.above(F.when(hopeful, x), F.when(hopeful, y), (limit - at_most(done, k)) / k.weight)
        else:
            # The optimizer merges neighbouring filters; the CASE keeps a costly score behind its guard.
            score = F.when(hopeful, k.score(x, y)) if k.cost > 1 else k.score(x, y)
        found = found.where(hopeful)
        found = found.withColumn(f"s_{k.name}", score)
        if k.cost > 0:
            # A filter on a plain column is pushed below it with the score written out, once more for every later stage;
            # none passes a generator, so each score is computed once.
            found = found.select(*found.columns[:-1], F.explode_outer(F.array(found.columns[-1])).alias(f"s_{k.name}"))
        done.append(k)
    total = sim.weighted({k.name: F.col(f"s_{k.name}") for k in scorers}, {k.name: k.weight for k in scorers})
    return found.drop(*[f"_u_{k.name}" for k in scorers]).where(total >= min_score)


def interpreted(value: Column) -> Column:
    """An array of ``value``, which a generator computes outside generated code."""
    return F.transform(F.array(F.lit(0)), lambda _: value)


def prune_and_score(
    pairs: DataFrame, min_score: float | Column, p: str = "_p", q: str = "_q", scorers: tuple[sim.Scorer, ...] | None = None
) -> DataFrame:
    """``similarity`` of pairs of profiles by the scorers, keeping those >= ``min_score`` (above 0)."""
    scorers = sim.scorers() if scorers is None else scorers
    total = sim.weighted({k.name: F.col(f"s_{k.name}") for k in scorers}, {k.name: k.weight for k in scorers})
    return scores_above(pairs, p, q, min_score, scorers).withColumn("similarity", total).drop(p, q, *[f"s_{k.name}" for k in scorers])


def _texts(cues: DataFrame, side: str) -> DataFrame:
    """Distinct normalised texts of a track; the first index of a text is its id."""
    norm = cues.select("media_id", "cue_idx", norm_text(F.col("text")).alias(f"{side}_norm"))
    return norm.groupBy("media_id", f"{side}_norm").agg(F.min("cue_idx").alias(f"{side}_id"))


def _weights(scorers: tuple[sim.Scorer, ...]) -> tuple[dict[str, float], float]:
    """Weights of the known scores, and of all others together."""
    known = {n: sum(k.weight for k in scorers if k.kind == n) for n in sim.WEIGHTS}
    return known, sum(k.weight for k in scorers if k.kind is None)


def _prefix_words(texts: DataFrame, side: str, need: float, w: dict[str, float]) -> DataFrame:
    """The words of each text of which a qualifying partner must share at least one.

    Words are ranked by a fixed order, commonest kinds first (stop words, then
    short words). As long as sharing *only* the first words of that order keeps
    the weighted jaccard, cosine and common below ``need``, these words cannot
    carry a pair on their own and are left out of the join. Jaccard is bounded by
    the share of the text's words, cosine by the root of the share of its squared
    counts (Cauchy-Schwarz), common by the share of its non-stop words. All of a
    text's words are in its row, so nothing is moved for it.
    """
    zero = F.lit(0).cast("bigint")
    counted = sim.with_counts(texts.select("media_id", f"{side}_id", F.col(f"{side}_norm").alias("_t")), "_t")
    entry = F.zip_with("_d", "_c", lambda word, tf: F.struct((~word.isin(*sim.STOP_WORDS)).cast("bigint").alias("solid"), F.length(word).alias("size"), word.alias("word"), tf.alias("tf")))
    ranked = counted.withColumn("_e", F.array_sort(entry)).withColumns({
        "_squares": F.aggregate("_e", zero, lambda s, e: s + e["tf"] * e["tf"]), "_solid": F.aggregate("_e", zero, lambda s, e: s + e["solid"]),
    })

    def step(s: Column, e: Column) -> Column:
        n, squares, solid = s["n"] + 1, s["squares"] + e["tf"] * e["tf"], s["solid"] + e["solid"]
        common = F.when(F.col("_solid") > 0, solid / F.greatest(F.col("_solid"), F.lit(1))).otherwise(1.0)
        bound = w["jaccard"] * (n / F.size("_e")) + w["cosine"] * F.sqrt(squares / F.col("_squares")) + w["common"] * common
        first = F.when((s["first"] == 0) & (bound >= need - 1e-9), n).otherwise(s["first"])
        return F.struct(n.alias("n"), squares.alias("squares"), solid.alias("solid"), first.alias("first"))

    start = F.struct(zero.alias("n"), zero.alias("squares"), zero.alias("solid"), zero.alias("first"))
    # The bound grows along the order, so the words from the first that reaches it on are wanted.
    found = ranked.withColumn("_first", F.aggregate("_e", start, step, lambda s: s["first"]).cast("int"))
    wanted = F.when(F.col("_first") > 0, F.transform(F.slice("_e", F.greatest("_first", F.lit(1)), F.size("_e")), lambda e: e["word"]))
    return found.select("media_id", f"{side}_id", F.explode_outer(wanted).alias("word")).where(F.col("word").isNotNull())


def _least_ratio(min_score: float, w: dict[str, float], others: float) -> float:
    """Least ratio of the shorter length to the longer that lets a pair without a common word reach ``min_score``.

    With that ratio r such a pair scores at most 2r / (1 + r) by sequence, and r by
    edit distance and by length.
    """
    low, high = 0.0, 1.0
    for _ in range(60):
        r = (low + high) / 2
        enough = w["sequence"] * 2 * r / (1 + r) + (w["edit"] + w["length"]) * r + others >= min_score
        low, high = (low, r) if enough else (r, high)
    return low if w["sequence"] + w["edit"] + w["length"] + others >= min_score else 2.0


def _similar_lengths(left: DataFrame, right: DataFrame, low: float) -> DataFrame:
    """Pairs of texts of at least the ratio ``low`` of lengths; texts meet in classes of that ratio."""
    if low > 1:
        return left.where("false").join(right, "media_id").select("media_id", "a_id", "b_id")
    if low <= 0:
        return left.join(right, "media_id").select("media_id", "a_id", "b_id")
    size = lambda side: F.greatest(F.length(f"{side}_norm"), F.lit(1))
    group = lambda side: F.floor(F.log(size(side)) / math.log(1 / min(low, 1 - 1e-6)) + 1e-9)
    a = left.where("a_norm <> ''").select("media_id", "a_id", size("a").alias("_la"), group("a").alias("_class"))
    b = right.where("b_norm <> ''").select("media_id", "b_id", size("b").alias("_lb"), F.explode(F.array(*[group("b") + k for k in (-1, 0, 1)])).alias("_class"))
    near = F.least("_la", "_lb") >= low * F.greatest("_la", "_lb") - 1e-9
    return a.join(b, ["media_id", "_class"]).where(near).select("media_id", "a_id", "b_id")


def gram_share(min_score: float, w: dict[str, float], others: float) -> float:
    """The share k of common two-character pieces that a pair without a common word needs; 0 or less: none.

    Such a pair needs ``w_s s + w_e e >= R`` of its sequence ratio s and edit
    similarity e, where R leaves the length ratio and all other scorers at 1. So s
    is s1 or more, or e is e1 or more, for any s1 and e1 on that line.

    * e >= e1: at most (1 - e1) L edits of the longer length L, each of which
      touches two pieces, so (2 e1 - 1) L - 1 pieces are common.
    * s >= s1: the blocks hold s (la + lb) / 2 characters; between two blocks lies a
      character outside, so there are at most (1 - s)(la + lb) + 1 blocks, and
      (3 s / 2 - 1)(la + lb) - 1 pieces inside blocks.

    With ``2 e1 - 1 = 3 s1 - 2 = k`` both have ``k (la + lb) / 2 - 1`` pieces or more.
    """
    room = min_score - w["length"] - others
    slope = w["sequence"] / 3 + w["edit"] / 2
    return (room - 2 * w["sequence"] / 3 - w["edit"] / 2) / slope if slope > 0 else (1.0 if room > 0 else 0.0)


def _common_grams(left: DataFrame, right: DataFrame, share: float, low: float) -> DataFrame:
    """Pairs that have ``share (la + lb) / 2 - 1`` two-character pieces or more in common, at the ratio ``low`` of lengths.

    Pieces are told apart by their number in the text, so that they are counted
    as often as they stand. Rare pieces of the media come first; a text needs
    some number of common pieces with any partner, so all but that many of its
    pieces, the rarest, hold one of them. Pairs that meet there are counted.
    """
    def pieces(texts: DataFrame, side: str) -> DataFrame:
        text = F.col(f"{side}_norm")
        each = texts.select(
            "media_id", F.col(f"{side}_id").alias("id"), F.length(text).alias("n"),
            F.posexplode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))).alias("at", "gram"),
        )
        number = F.row_number().over(Window.partitionBy("media_id", "id", "gram").orderBy("at"))
        return each.withColumn("piece", F.concat("gram", number.cast("string"))).select("media_id", "id", "n", "piece", F.lit(side).alias("side"))

    long = lambda side: F.length(f"{side}_norm") > 1
    both = cut_lineage(pieces(left.where(long("a")), "a").unionByName(pieces(right.where(long("b")), "b")), "pieces")
    rare = both.groupBy("media_id", "piece").agg(F.count(F.lit(1)).alias("_df"), F.min("side").alias("_x"), F.max("side").alias("_y"))
    # A piece that one track alone has can't be common.
    known = both.join(rare.where("_x <> _y").select("media_id", "piece", "_df"), ["media_id", "piece"])
    text = Window.partitionBy("media_id", "side", "id")
    need = F.ceil(share * F.col("n") * (1 + low) / 2 - 1 - 1e-9)
    ranked = known.withColumn("_lone", F.col("n") - 1 - F.count(F.lit(1)).over(text)).withColumn(
        "_rank", F.row_number().over(text.orderBy("_df", "piece"))
    )
    # The pieces of one track alone are the first of any order, so they use up the places before the others.
    prefix = ranked.where((need >= 1) & (F.col("_rank") <= F.col("n") - need - F.col("_lone"))).select("media_id", "side", "id", "n", "piece")
    prefix = cut_lineage(prefix, "prefix")
    side = lambda name: prefix.where(F.col("side") == name).select("media_id", F.col("id").alias(f"{name}_id"), F.col("n").alias(f"_n{name}"), "piece")
    near = F.least("_na", "_nb") >= low * F.greatest("_na", "_nb") - 1e-9
    met = side("a").join(side("b"), ["media_id", "piece"]).where(near).select("media_id", "a_id", "b_id", "_na", "_nb").distinct()
    whole = both.groupBy("media_id", "side", "id").agg(F.collect_list("piece").alias("pieces"))
    of = lambda name: whole.where(F.col("side") == name).select("media_id", F.col("id").alias(f"{name}_id"), F.col("pieces").alias(f"_{name}"))
    counted = met.join(of("a"), ["media_id", "a_id"]).join(of("b"), ["media_id", "b_id"])
    enough = F.size(F.array_intersect("_a", "_b")) >= share * (F.col("_na") + F.col("_nb")) / 2 - 1 - 1e-9
    return counted.where(enough).select("media_id", "a_id", "b_id")


def candidate_pairs(left: DataFrame, right: DataFrame, min_score: float, scorers: tuple[sim.Scorer, ...]) -> DataFrame:
    """``media_id, a_id, b_id``: the pairs of distinct texts that are to be scored; none that qualifies is missing."""
    w, others = _weights(scorers)
    need = min_score - others - w["sequence"] - w["edit"] - w["length"]
    pairs = _prefix_words(left, "a", need, w).join(_prefix_words(right, "b", need, w), ["media_id", "word"]).select(
        "media_id", "a_id", "b_id"
    )
    if need < w["common"] + 1e-9:
        # Pairs without a common word: of texts that have none but stop words (these count as alike), and of others.
        plain = lambda texts, side: texts.where(F.size(F.array_except(sim.words(F.col(f"{side}_norm")), F.array(*[F.lit(x) for x in sim.STOP_WORDS]))) == 0)
        alike = _similar_lengths(plain(left, "a"), plain(right, "b"), _least_ratio(min_score, w, others + w["common"]))
        pairs = pairs.unionByName(alike)
    if need <= 1e-9:
        low, share = _least_ratio(min_score, w, others), gram_share(min_score, w, others)
        if share <= 0 or low <= 0:
            pairs = pairs.unionByName(_similar_lengths(left, right, low))
        elif low <= 1:
            # Texts too short to need a common piece, and their partners.
            longest = 4 / (share * (1 + low)) / low + 1
            short = lambda texts, side: texts.where(F.length(f"{side}_norm") <= longest)
            pairs = pairs.unionByName(_similar_lengths(short(left, "a"), short(right, "b"), low)).unionByName(_common_grams(left, right, share, low))
    empty = left.where("a_norm = ''").join(right.where("b_norm = ''"), "media_id").select("media_id", "a_id", "b_id")
    return pairs.unionByName(empty).distinct()


def text_pairs(
    src: DataFrame, ref: DataFrame, min_score: float, scorers: tuple[sim.Scorer, ...] | None = None, best: bool = False
) -> DataFrame:
    """All distinct text pairs of a media whose weighted scores reach ``min_score``, exactly.

    Prefix filter: with every other score at its maximum of 1 a pair still needs
    some of jaccard, cosine and common, so its rarest shared word is a prefix word
    on both sides. The word join carries text ids only; texts are attached to the
    distinct id pairs. Where pairs without a common word can qualify too, they
    come from an index of two-character pieces (see :func:`gram_share`), or, at
    thresholds that need none, from classes of similar lengths.
    ``media_id, a_id, b_id, similarity, _var`` with the texts' first indexes as ids.

    With ``best`` only the best partners of a source text need be found. By the
    six scores a text with words scores 1 with its equal and less with any other
    (edit distance and sequence ratio tell them apart), so a text that the other
    track has too meets that one alone.
    """
    if best and scorers is not None:
        raise ValueError("what an equal text scores is known of the six scores alone")
    if not 0.0 <= min_score <= 1.0:
        raise ValueError("a similarity threshold lies between 0 and 1")
    left, right = cut_lineage(_texts(src, "a"), "texts"), cut_lineage(_texts(ref, "b"), "texts")
    return _pairs_of_texts(left, right, min_score, scorers, best)


def _pairs_of_texts(
    left: DataFrame, right: DataFrame, min_score: float, scorers: tuple[sim.Scorer, ...] | None = None, best: bool = False
) -> DataFrame:
    """:func:`text_pairs` of the distinct texts of both tracks, written.

    Texts and sketches go to the pairs; profiles, several times as large, are
    never moved and are made of the pairs that the sketches leave.
    """
    scorers = sim.scorers() if scorers is None else scorers
    if best:
        worded = left.where(F.size(sim.words(F.col("a_norm"))) > 0).withColumnRenamed("a_norm", "b_norm")
        equal = cut_lineage(worded.join(right, ["media_id", "b_norm"]).select("media_id", "a_id", "b_id"), "equal")
        others = left.join(equal.select("media_id", "a_id"), ["media_id", "a_id"], "left_anti")
        pairs = candidate_pairs(others, right, min_score, scorers).unionByName(equal)
    else:
        pairs = candidate_pairs(left, right, min_score, scorers)
    pairs = cut_lineage(pairs, "candidates")

    def brief(texts: DataFrame, side: str, out: str) -> DataFrame:
        return sim.with_brief(texts.repartition("media_id", f"{side}_id"), f"{side}_norm", out).drop(f"{side}_norm")

    met = pairs.join(brief(left, "a", "_p"), ["media_id", "a_id"]).join(brief(right, "b", "_q"), ["media_id", "b_id"])
    # Own scorers may look at more than the sketches: here they count as their weights.
    most = sum((k.weight * (k.bound(F.col("_p"), F.col("_q")) if k.kind and k.bound else F.lit(1.0)) for k in scorers if k.weight > 0), F.lit(0.0))
    hopeful = met.select("*", F.explode_outer(interpreted(most)).alias("_most")).where(F.col("_most") >= min_score - 1e-9).select(
        "media_id", "a_id", "b_id", F.col("_p.text").alias("_a"), F.col("_q.text").alias("_b")
    )
    attached = sim.with_profile(sim.with_profile(hopeful, "_a", "_p"), "_b", "_q").drop("_a", "_b")
    full = scores_above(attached, "_p", "_q", min_score, scorers).drop("_p", "_q")
    total = sim.weighted({k.name: F.col(f"s_{k.name}") for k in scorers}, {k.name: k.weight for k in scorers})
    return full.select(
        "media_id", "a_id", "b_id", total.alias("similarity"), sim.variance_penalty([F.col(f"s_{k.name}") for k in scorers]).alias("_var"),
    )


def similarity_align(src: DataFrame, ref: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Best reference of every source by combined similarity, then one source per reference.

    ``media_id, src_idx, ref_idx, similarity, confidence``. Cue indexes are
    positions in their list, as the position penalty needs them.
    """
    left, right = cut_lineage(_texts(src, "a"), "texts"), cut_lineage(_texts(ref, "b"), "texts")
    best = _pairs_of_texts(left, right, min_confidence, best=True).groupBy("media_id", "a_id").agg(
        F.max_by(
            F.struct(F.col("b_id").alias("ref_idx"), "similarity", "_var"),
            F.struct("similarity", (-F.col("b_id")).alias("t")),
        ).alias("m")
    ).select("media_id", "a_id", "m.*").join(left, ["media_id", "a_id"])
    best = cut_lineage(best, "best")
    sizes = src.groupBy("media_id").agg(F.count("*").alias("n_src")).join(
        ref.groupBy("media_id").agg(F.count("*").alias("n_ref")), "media_id"
    )
    cues = src.select("media_id", F.col("cue_idx").alias("src_idx"), norm_text(F.col("text")).alias("a_norm"))
    placed = cues.join(best.join(sizes, "media_id"), ["media_id", "a_norm"])
    position = sim.position_penalty(F.col("src_idx"), F.col("ref_idx"), F.col("n_src"), F.col("n_ref"))
    confident = placed.select(
        "media_id", "src_idx", "ref_idx", "similarity",
        sim.confidence(F.col("similarity"), position, F.col("_var")).alias("confidence"),
    ).where(F.col("confidence") >= min_confidence)
    return best_per_reference(confident, "confidence")


#: References per task key where samples meet windows of a track.
WINDOW_CUES = 64


def similarity_sample(src: DataFrame, ref: DataFrame, k: int = 20, min_score: float = 0.6) -> DataFrame:
    """Evenly sampled sources against references around the proportional position, one-to-one.

    At most ``k`` windows of a fifth of the track per media. Samples are copied to
    the runs of ``WINDOW_CUES`` references that their windows touch and meet the
    references there, so that the pairs are made behind the exchange, never moved.
    """
    sizes = src.groupBy("media_id").agg(F.count("*").alias("n_src")).join(
        ref.groupBy("media_id").agg(F.count("*").alias("n_ref")), "media_id"
    )
    center = "cue_idx * (n_ref - 1) div greatest(1L, n_src - 1)"
    window = "greatest(10L, n_ref div 10)"
    sampled = even_sample(src, k).where(F.length(F.trim("text")) >= 5).join(sizes, "media_id").select(
        "media_id", F.col("cue_idx").alias("src_idx"), "text",
        F.expr(f"greatest(0L, {center} - {window})").alias("_from"), F.expr(f"least(n_ref, {center} + {window}) - 1").alias("_to"),
    )
    runs = F.explode(F.expr(f"sequence(_from div {WINDOW_CUES}, _to div {WINDOW_CUES})"))
    wanted = profiled(sampled.withColumn("_run", runs).repartition("media_id", "_run"), "text", "_p").drop("text")
    refs = ref.where((F.length(F.trim("text")) >= 5) & (F.col("cue_idx") >= 0)).select(
        "media_id", F.col("cue_idx").alias("ref_idx"), "text", F.expr(f"cue_idx div {WINDOW_CUES}").alias("_run")
    )
    # The profiles are several times as large as the texts: these are moved.
    refs = profiled(refs.repartition("media_id", "_run"), "text", "_q").drop("text")
    met = wanted.join(refs, ["media_id", "_run"]).where("ref_idx between _from and _to").drop("_run", "_from", "_to")
    scored = cut_lineage(prune_and_score(met, min_score), "sampled")
    edges = scored.select("media_id", "src_idx", "ref_idx", F.col("similarity").alias("score"), F.lit(0.0).alias("near"))
    picks = match_serial(edges)
    return picks.join(edges.drop("near"), ["media_id", "src_idx", "ref_idx"]).withColumnRenamed("score", "confidence")


def anchor_similarity(a: DataFrame, b: DataFrame, k: int = 5, min_score: float = 0.05) -> DataFrame:
    """Best pair of the first ``k`` cues by the anchor weights; last resort of the anchor search."""
    def head(cues: DataFrame, idx: str) -> DataFrame:
        first = cues.where(F.col("cue_idx") < k).where(F.length(F.trim("text")) >= 5)
        return first.select("media_id", F.col("cue_idx").alias(idx), "text")

    return best_pair(head(a, "a_idx"), head(b, "b_idx"), min_score, sim.scorers(sim.ANCHOR_WEIGHTS))


def best_pair(
    left: DataFrame, right: DataFrame, threshold: float, scorers: tuple[sim.Scorer, ...] | None = None,
    bonus: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Best pair per media of ``media_id, a_idx, text`` and ``media_id, b_idx, text``; it has ``threshold`` or more with its ``bonus``.

    The weights add up to 1. ``left`` has few cues per media, which the cues of
    ``right`` meet as an array. Equal texts score 1, so a media that has some needs
    no pair that its bounds keep below the best of them; lengths tell that of most
    pairs before words or characters are looked at.
    """
    scorers = sim.scorers() if scorers is None else scorers
    extra = bonus or (lambda i, j: F.lit(0.0))
    # The profiles are several times as large as the texts: these are moved.
    few = profiled(left.repartition("media_id"), "text", "_p").groupBy("media_id").agg(F.collect_list(F.struct("a_idx", "_p")).alias("_few"))
    both = profiled(right.repartition("media_id"), "text", "_q").drop("text").join(few, "media_id")
    text, length = F.col("_q.text"), F.length(F.col("_q.text"))
    equal = F.transform(F.filter("_few", lambda x: (x["_p"]["text"] == text) & (text != "")), lambda x: 1 - 1e-6 + extra(x["a_idx"], F.col("b_idx")))
    known = both.groupBy("media_id").agg(F.max(F.array_max(equal)).alias("_known"))
    least = F.greatest(F.lit(threshold), F.col("_known"))
    known_both = both.join(known, "media_id").withColumn("_least", least)

    def hopeful(x: Column) -> Column:
        pair = x["_p"], F.col("_q")
        by_length = lambda k: k.bound(*pair) if k.bound and k.cost > 1 else k.score(*pair) if k.cost == 0 else F.lit(1.0)
        by_words = lambda k: k.bound(*pair) if k.bound else by_length(k)
        most = [sum((k.weight * bound(k) for k in scorers), F.lit(0.0)) + extra(x["a_idx"], F.col("b_idx")) for bound in (by_length, by_words)]
        return (most[0] >= F.col("_least") - 1e-9) & (most[1] >= F.col("_least") - 1e-9)

    met = known_both.select("media_id", "b_idx", "_q", "_least", F.inline(F.filter("_few", hopeful)))
    gain = extra(F.col("a_idx"), F.col("b_idx"))
    scored = prune_and_score(met, F.col("_least") - gain - 1e-9, scorers=scorers).withColumn("confidence", F.col("similarity") + gain)
    return top_pair(scored.where(F.col("confidence") >= threshold))


def top_pair(pairs: DataFrame, score: str = "confidence") -> DataFrame:
    """Best pair per media, ties to the lower indexes."""
    order = F.struct(F.col(score), (-F.col("a_idx")).alias("_i"), (-F.col("b_idx")).alias("_j"))
    best = F.max_by(F.struct("a_idx", "b_idx", F.col(score).alias("confidence")), order)
    return pairs.groupBy("media_id").agg(best.alias("m")).select("media_id", "m.a_idx", "m.b_idx", "m.confidence")


def anchor_translated(
    src: DataFrame, ref: DataFrame, translations: DataFrame, limit: int = 20,
    threshold: float = 0.5,
) -> DataFrame:
    """Best pair of a translated early source cue and any reference cue, with an early-position bonus.

    ``translations`` is ``text, translated`` for the target language. The
    bonus is 0.1 at position (0, 0) and is gone after 20 positions, so a pair
    counts if its similarity reaches the threshold less its own bonus; pairs
    that cannot are cut before the sequence ratio is computed.
    """
    early = _translated(src.where(F.col("cue_idx") < limit), translations)
    return best_pair(early, _references(ref), threshold, bonus=lambda i, j: F.greatest(F.lit(0.0), 0.1 - (i + j) * 0.005))


def _translated(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """``media_id, a_idx, text`` of cues with a translation; one translation per text."""
    one = translations.groupBy("text").agg(F.min("translated").alias("translated")).where(F.trim("translated") != "")
    return cues.join(one, "text").select("media_id", F.col("cue_idx").alias("a_idx"), F.col("translated").alias("text"))


def _references(cues: DataFrame) -> DataFrame:
    return cues.where(F.trim("text") != "").select("media_id", F.col("cue_idx").alias("b_idx"), "text")


def anchor_sampled(
    src: DataFrame, ref: DataFrame, translations: DataFrame, k: int = 15, threshold: float = 0.5
) -> DataFrame:
    """Best pair between evenly sampled translated sources and evenly sampled references."""
    return best_pair(_translated(even_sample(src, k), translations), _references(even_sample(ref, k)), threshold)


def anchor_quartiles(src: DataFrame, ref: DataFrame, translations: DataFrame, scan: int = 20, threshold: float = 0.7) -> DataFrame:
    """Five positions of the first ``scan`` cues on each side, two-way text similarity.

    The scan is as long as the shorter track allows, so a media has its own
    positions: the first, a quarter, half and three quarters in, and the last.
    """
    sizes = src.groupBy("media_id").agg(F.count("*").alias("_n1")).join(ref.groupBy("media_id").agg(F.count("*").alias("_n2")), "media_id")
    long = F.least(F.lit(scan), "_n1", "_n2").cast("int")
    spots = F.array_distinct(F.array(F.lit(0), F.floor(long / 4), F.floor(long / 2), F.floor(3 * long / 4), long - 1).cast("array<int>"))
    wanted = sizes.select("media_id", spots.alias("_spots"))

    def at_spots(cues: DataFrame) -> DataFrame:
        return cues.join(wanted, "media_id").where(F.array_contains("_spots", F.col("cue_idx"))).drop("_spots")

    left = at_spots(src).join(
        translations.select("text", "translated").dropDuplicates(["text"]), "text"
    ).select("media_id", F.col("cue_idx").alias("a_idx"), F.lower(F.trim("translated")).alias("_a"))
    right = at_spots(ref).select("media_id", F.col("cue_idx").alias("b_idx"), F.lower(F.trim("text")).alias("_b"))
    scored = left.join(right, "media_id").withColumn("confidence", sim.text_sim2(F.col("_a"), F.col("_b")))
    return top_pair(scored.where(F.col("confidence") >= threshold))
