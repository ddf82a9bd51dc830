"""Composition against a plain loop, and each way in which a scene can end."""

import numpy as np
import pytest

from orbweave.operators.compose import compose
from orbweave.plans import retrieval

Q, G = "scene long, query_id long, vec array<double>, region string", "id long, vec array<double>, region string"


def world(seed=4, n=40, scenes=3, slots=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 6))
    g = [(i, v.tolist(), "abc"[i % 3]) for i, v in enumerate(x)]
    q = [(s, 1000 + 10 * s + k, rng.standard_normal(6).tolist(), "abcd"[(s + k) % 3]) for s in range(scenes) for k in range(slots - s)]
    return q, g


def by_hand(q, g, mode="iterative", weight=0.3, least=-9.0, objects=25, calls=30):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    x, region, ids = np.stack([unit(v) for _, v, _ in g]), np.array([r for *_, r in g]), np.array([i for i, *_ in g])
    out, ends = [], {}
    for scene in sorted({s for s, *_ in q}):
        own = sorted((r for r in q if r[0] == scene), key=lambda r: r[1])
        layout, taken, used, why = None, [], 0, None
        for step, (_, qid, vec, reg) in enumerate(own):
            for tries in range(2):
                if why:
                    break
                v = unit(vec) + (weight * layout if layout is not None and not tries and mode != "parallel" else 0)
                sim = x @ v
                free = ids != qid
                if mode != "parallel":
                    free &= ~np.isin(ids, taken)
                if mode == "region":
                    free &= region == reg
                used += 1
                best = int(np.where(free, sim, -np.inf).argmax())
                if free.any() and sim[best] / np.linalg.norm(v) >= least:
                    out.append((scene, step, qid, int(ids[best]), pytest.approx(sim[best])))
                    layout = x[best] if layout is None else (layout * len(taken) + x[best]) / (len(taken) + 1)
                    taken.append(int(ids[best]))
                    break
                if tries or least == -9.0:
                    why = "no_candidate"
                elif used >= calls:
                    why = "call_budget"
            done = len(taken) == len(own)
            why = why or (None if done else "object_budget" if len(taken) >= objects else "call_budget" if used >= calls else None)
        ends[scene] = (len(own), len(taken), used, "SUCCESS" if len(taken) == len(own) else "EXHAUSTED", None if len(taken) == len(own) else why)
    return out, ends


def run(spark, q, g, mode="iterative", **budgets):
    objects, scenes = compose(spark.createDataFrame(q, Q).repartition(3), spark.createDataFrame(g, G).repartition(3), mode, **budgets)
    return sorted(tuple(r) for r in objects.collect()), {r.scene: tuple(r)[1:] for r in scenes.collect()}


@pytest.mark.parametrize("mode,least,objects,calls", [("iterative", None, 25, 30), ("region", None, 25, 30), ("parallel", None, 25, 30), ("iterative", None, 3, 30), ("iterative", None, 25, 2), ("region", 0.75, 25, 30), ("iterative", 0.72, 25, 4)])
def test_against_a_plain_loop(spark, mode, least, objects, calls):
    q, g = world()
    got, ends = run(spark, q, g, mode, least=least, max_objects=objects, max_calls=calls)
    want, how = by_hand(q, g, mode, least=-9.0 if least is None else least, objects=objects, calls=calls)
    assert ends == how and [(*r[:4],) for r in got] == [(*r[:4],) for r in want] and all(a[4] == b[4] for a, b in zip(got, want))


def test_every_exit(spark):
    q, g = world(scenes=2, slots=4)
    ticks = iter(range(0, 1000, 10))
    _, ends = run(spark, q, g, max_seconds=20, clock=lambda: next(ticks))
    assert ends[0] == (4, 2, 2, "EXHAUSTED", "time_budget") and ends[1] == (3, 2, 2, "EXHAUSTED", "time_budget")
    _, ends = run(spark, q, g, max_objects=3)
    assert ends[0][3:] == ("EXHAUSTED", "object_budget") and ends[1][3:] == ("SUCCESS", None)
    _, ends = run(spark, q, g, max_calls=3)
    assert ends[0][3:] == ("EXHAUSTED", "call_budget") and ends[1][3:] == ("SUCCESS", None)
    _, ends = run(spark, q, g[:2])
    assert {e[3:] for e in ends.values()} == {("EXHAUSTED", "no_candidate")} and {e[1] for e in ends.values()} == {2}
    lost = [(s, i, v, None) for s, i, v, _ in q]
    objects, ends = run(spark, lost, [(*r[:2], None) for r in g], "region")
    assert objects == [] and {e[1:] for e in ends.values()} == {(0, 1, "EXHAUSTED", "no_candidate")}
    objects, ends = run(spark, q, g, max_objects=0)
    assert objects == [] and {e[1:] for e in ends.values()} == {(0, 0, "EXHAUSTED", "object_budget")}
    assert run(spark, [], g) == ([], {}) and run(spark, [], g, "parallel") == ([], {})
    with pytest.raises(ValueError, match="mode"):
        run(spark, q, g, "sideways")


def test_only_the_result_is_left(spark):
    q, g = world(scenes=1, slots=3)
    objects, _ = compose(spark.createDataFrame(q, Q), spark.createDataFrame(g, G))
    from pathlib import Path

    at = Path(objects.inputFiles()[0].removeprefix("file://")).parents[2]
    assert sorted(p.name for p in at.iterdir() if list(p.glob("*"))) == ["objects", "state"] and len([p for p in (at / "state").iterdir() if p.is_dir()]) == 1


def test_every_query_row_gets_an_object_of_its_scene(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((190, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    g = [(i, v.astype(float).tolist(), "a") for i, v in enumerate(x)]
    want, _ = by_hand([(i // 60, i, v, "a") for i, v, _ in g if i % 20 == 0], g)
    got = sorted(tuple(r) for r in retrieval.compose_iterative(spark, str(tmp_path), slots=3).collect())
    assert len(want) == 10 and [r[:4] for r in got] == [r[:4] for r in want] and all(a[4] == b[4] for a, b in zip(got, want))
