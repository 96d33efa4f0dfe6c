import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from answerloom.functions import prompts as P
from answerloom.operators import rollouts, voting


def frame(spark, rows):
    return spark.createDataFrame(rows, "item int, sample_idx int, answer string, score double, full_text string")


def test_majority_and_ties(spark):
    df = frame(spark, [
        (1, 0, "2", 0.1, "a"), (1, 1, "2", 0.2, "b"), (1, 2, "3", 0.9, "c"),
        (2, 0, "x", 0.1, "d"), (2, 1, "y", 0.7, "e"), (2, 2, "y", 0.1, "f"), (2, 3, "x", 0.7, "g"),
    ])
    vote = {r.item: r for r in voting.majority_vote(df).collect()}
    assert (vote[1].final_answer, vote[1].n_winners, vote[1].top_count, vote[1].n_samples) == ("2", 1, 2, 3)
    assert (vote[2].final_answer, vote[2].n_winners, vote[2].first_answer) == (None, 2, "x")
    winners = {(r.item, r.answer) for r in voting.majority_winners(df).collect()}
    assert winners == {(1, "2"), (2, "x"), (2, "y")}
    scored = {r.item: r.final_answer for r in voting.score_tie_break(df).collect()}
    assert scored == {1: "2", 2: "x"}  # equal best scores: the earlier answer
    best = {r.item: (r.sample_idx, r.answer) for r in voting.best_of_n(df).collect()}
    assert best == {1: (2, "3"), 2: (1, "y")}


def test_refinement_chain(spark):
    texts = ["initial draft", "draft with more detail", "bad"]
    df = spark.createDataFrame(
        [(1, i, float(len(x)), x) for i, x in enumerate(texts)],
        "item int, iteration int, score double, text string",
    )
    marks = [r.accepted for r in voting.accepted_revisions(df).orderBy("iteration").collect()]
    assert marks == [True, True, False]
    final = voting.refine_finals(df).first()
    assert (final.text, final.n_steps) == ("draft with more detail", 3)


def test_advantages(spark):
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate([1.0, 2.0, 4.0])] + [(2, 0, 5.0)],
                               "prompt_id int, rollout_id int, reward double")
    out = rollouts.group_advantage(df)
    got = [r.advantage for r in out.where("prompt_id = 1").orderBy("rollout_id").collect()]
    mean, std = 7 / 3, math.sqrt(((1 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2 + (4 - 7 / 3) ** 2) / 2)
    want = [(x - mean) / (std + 1e-4) for x in (1, 2, 4)]
    assert got == pytest.approx(want)
    assert out.where("prompt_id = 2").first().advantage is None
    stats = rollouts.advantage_stats(out.withColumn("step", F.lit(0)).where("prompt_id = 1")).first()
    assert stats.adv_avg == pytest.approx(0.0, abs=1e-12)
    assert stats.adv_std == pytest.approx(std / (std + 1e-4))


def test_entropy_and_logprob(spark):
    logits = [0.1, 0.3, 0.6]
    total = math.log(sum(map(math.exp, logits)))
    logp = [x - total for x in logits]
    ids, prompt_len = [0, 2, 1, 2], 2
    chosen = [(1, pos, logp[ids[pos + 1]], prompt_len) for pos in range(3)]
    rows = spark.createDataFrame(chosen, "seq_id int, pos int, logp double, prompt_len int")
    assert rollouts.sequence_logprob(rows).first().logprob == pytest.approx(logp[1] + logp[2])
    dist = [(1, pos, math.exp(lp), prompt_len) for pos in range(3) for lp in logp]
    grid = spark.createDataFrame(dist, "seq_id int, pos int, p double, prompt_len int")
    entropy = -sum(math.exp(x) * x for x in logp)
    assert rollouts.mean_step_entropy(grid).first().entropy == pytest.approx(entropy)
    empty = rows.withColumn("prompt_len", F.lit(9))
    assert rollouts.sequence_logprob(empty).first().logprob == 0.0
    assert rollouts.mean_step_entropy(grid.withColumn("prompt_len", F.lit(9))).first().entropy == 0.0
    assert rollouts.mean_answer_logprob(empty).first().avg_logprob == -1e9


def test_tag_order(spark):
    texts = ["Let's ... <think> ... </think> ...", "Let's ... <th1nk> ... </think> ...",
             "Let's ... </think> ... <think> ...", "Let's ... <think> ..."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(P.tag_order_reward("t")).collect()] == [1.0, 0.0, 0.0, 0.0]
    ids = spark.createDataFrame(
        [([1, 8, 5, 9], 1), ([1, 9, 8], 1), ([8, 9], 1), ([8, 1, 8, 9], 1), ([1], 1)], "a array<int>, n int"
    )
    got = [r[0] for r in ids.select(P.tag_order_reward_ids("a", "n", 8, 9)).collect()]
    assert got == [1.0, 0.0, 0.0, 1.0, 0.0]


def test_objective_modes(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0), (-1.0, 0.5), (1.0, 0.5)], "adv double, ratio double")
    signed = [r[0] for r in rows.select(rollouts.clipped_objective(F.col("adv"), F.col("ratio"))).collect()]
    ppo = [r[0] for r in rows.select(rollouts.clipped_objective(F.col("adv"), F.col("ratio"), mode="ppo")).collect()]
    assert signed == pytest.approx([1.2, -1.2, -0.5, 0.5])
    assert ppo == pytest.approx([1.2, -2.0, -0.8, 0.5])


def _stopped_by_hand(rows):
    """Kept rows and vote of every item, sample by sample; rows without an index come first."""
    kept, votes = [], []
    for item in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == item), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, stop = Counter(), None
        for _, idx, answer in mine:
            seen[answer] += 1
            if seen[answer] * 2 > len(mine):
                stop = (idx is not None, idx or 0)
                break
        used = [r for r in mine if stop is None or (r[1] is not None, r[1] or 0) <= stop]
        kept += used
        counts = Counter(r[2] for r in used)
        top = max(counts.values())
        best = [a for a, n in counts.items() if n == top]
        votes.append((item, len(used), top, len(best), best[0] if len(best) == 1 else None))
    return kept, votes


@pytest.mark.parametrize("segment_rows", [2, 1000])
def test_early_stop_by_candidate(spark, segment_rows):
    rng = random.Random(segment_rows)
    rows = []
    for item in [*range(40), None]:
        answers = rng.choice([["a", "b", None], ["a"], ["a", "a", "a", "b", "c"]])
        for i in range(rng.randrange(1, 25)):
            idx = rng.choice([i, i, i, i // 2, None if item in (3, 4) else i, -i])
            rows.append((item, idx, rng.choice(answers)))
    df = spark.createDataFrame(rows, "item int, sample_idx int, answer string")
    kept, votes = _stopped_by_hand(rows)
    got = voting.samples_until_majority(df, segment_rows=segment_rows)
    assert Counter(map(tuple, got.collect())) == Counter(kept)
    vote = voting.early_stopped_vote(df, segment_rows=segment_rows).drop("first_answer")
    assert Counter(map(tuple, vote.collect())) == Counter(votes)


def test_early_stop_windows_see_few_rows(spark):
    """One item of 20,000 samples: only one segment of the winning answer's indexes is added up."""
    df = spark.range(20000).select(
        F.lit(1).alias("item"), F.col("id").alias("sample_idx"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("answer")
    )
    vote = voting.early_stopped_vote(df, segment_rows=100).first()
    assert (vote.n_samples, vote.top_count, vote.final_answer) == (15002, 10001, "a")
