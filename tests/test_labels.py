"""Labelling problems against enumeration, their learner against chance, learners kept in files."""

import itertools

import numpy as np
import pytest

from weftline import cli
from weftline.operators import labels as B
from weftline.operators import learners as T


def drawn(kind, rng, n=9, k=3):
    a, b = np.triu_indices(n, 1)
    on = rng.random(len(a)) < 0.35
    return B.Labelling(kind, n, a[on], b[on], k)


@pytest.mark.parametrize("kind", ["cut", "colouring", "partition"])
def test_rewards_add_up(kind):
    rng = np.random.default_rng(1)
    for _ in range(5):
        p = drawn(kind, rng)
        label, total = p.start(), 0.0
        for node in rng.permutation(p.n).tolist():
            label, r = p.step(label, node, int(rng.integers(3)))
            total += r
        same = sum(label[a] == label[b] for a, b in zip(p.src, p.dst, strict=True))
        m = max(len(p.src), 1)
        want = -same / m if kind == "colouring" else (len(p.src) - same) / m
        if kind == "partition":
            want -= sum(max((label == c).sum() - 3, 0) ** 2 for c in range(3)) / 9
        assert total == pytest.approx(want)
        for v in range(p.n):
            near = [b if a == v else a for a, b in zip(p.src, p.dst, strict=True) if v in (a, b)]
            assert p.histogram(label)[v].tolist() == [sum(label[x] == c for x in near) for c in range(3)]


def test_label_learner():
    of, rng = B.LabelLearner(3, seed=0), np.random.default_rng(4)
    for t in range(150):
        of.episode(drawn("cut", rng), max(0.05, 1 - 2 * t / 150))
    found, best, chance = [], [], []
    for _ in range(10):
        p = drawn("cut", rng, n=7)
        label = B.labelled(of, p)
        assert (label >= 0).all() and (label < 3).all()
        every = [p.value(np.array(x)) for x in itertools.product(range(3), repeat=7)]
        found.append(p.value(label))
        best.append(max(every))
        chance.append(np.mean(every))
        assert found[-1] <= best[-1] + 1e-9
    assert np.mean(found) > np.mean(chance)
    empty = B.Labelling("cut", 0, [], [])
    assert of.episode(empty) == 0 and len(B.labelled(of, empty)) == 0
    with pytest.raises(ValueError):
        B.Labelling("other", 1, [], [])


def test_kept_learners(tmp_path):
    rng = np.random.default_rng(2)
    p = T.random_problem("cover", rng)
    for name, make in T.LEARNERS.items():
        of = make(1)
        for _ in range(4):
            of.episode(T.random_problem("cover", rng), 0.5)
        back = B.restored(make(7), B.saved(of, tmp_path / f"{name}.npz"))
        assert T.played(back, p) == T.played(of, p), name
    of = B.LabelLearner(2, seed=1)
    q = drawn("colouring", rng, k=2)
    of.episode(q, 0.5)
    assert (B.labelled(B.restored(B.LabelLearner(2, seed=3), B.saved(of, tmp_path / "labels.npz")), q) == B.labelled(of, q)).all()
    with pytest.raises(ValueError):
        B.restored(B.LabelLearner(3), tmp_path / "labels.npz")
    assert not list(tmp_path.glob("*.part"))


def test_train_and_eval(tmp_path, capsys):
    kept = str(tmp_path / "x.npz")
    cli.main(["train", "double", "--problem", "independent", "--episodes", "5", "--out", kept])
    cli.main(["eval", "double", "--problem", "independent", "--weights", kept])
    first, second = capsys.readouterr().out.split()
    assert first == second and 0 < float(first) <= 1
    for name in ("b", "a"):
        (tmp_path / f"{name}.yaml").write_text("x: 1")
    cli.main(["configs", "--data", str(tmp_path)])
    assert capsys.readouterr().out.split() == ["a", "b"]
