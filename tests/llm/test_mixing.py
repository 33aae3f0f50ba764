from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tarn.llm import mixing as mx
from tests.llm.conftest import ODD


def simulate(blocks, weights, quantum):
    """Slot by slot: earliest deadline first among the released blocks of sources that still have some."""
    order, done, left = [], Counter(), dict(blocks)
    while any(left.values()):
        shares = mx.quantised({s: weights[s] for s in left if left[s]}, quantum)
        done, t = Counter(), 0
        while all(left[s] for s in shares) or True:
            ready = [(-(-(done[s] + 1) * quantum // q), s) for s, q in shares.items() if done[s] * quantum // q <= t]
            due, source = min(ready)
            if not left[source]:
                break
            order.append(source)
            done[source] += 1
            left[source] -= 1
            t += 1
    return order


@pytest.mark.parametrize("sizes,weights", [({"a": 50, "b": 50, "c": 7}, {"a": 0.6, "b": 0.3, "c": 0.1}), ({"a": 3, "b": 100}, {"a": 1, "b": 1}), ({"a": 1}, {"a": 5})])
def test_plan_follows_the_simulation(sizes, weights):
    rows = mx.plan(sizes, weights, 20)
    slots = {}
    for s, _, start, stop, first, share, place, at in rows:
        for block in range(start, stop):
            if (block - start) % share == place:
                slots[first + (block - start) // share * 20 + at] = s
    assert sorted(slots) == list(range(sum(sizes.values())))
    assert [slots[t] for t in sorted(slots)] == simulate(sizes, weights, 20)


def test_less_than_one_block_of_deviation():
    shares = mx.quantised({f"s{i}": w for i, w in enumerate([900, 10, 10, 10, 25, 45])}, 1000)
    done = Counter()
    for t, s in enumerate(mx.one_period(shares), 1):
        done[s] += 1
        assert all(abs(done[x] - Fraction(t * q, 1000)) < 1 for x, q in shares.items())
    assert done == shares


def test_exact_weights_stay_within_one_block_at_any_size():
    sizes = [60_000, *[6_000 + 311 * i for i in range(19)]]
    weights = [n**0.5 for n in sizes]
    done, end = Counter(), 0
    for part in mx.schedule(sizes, weights, 10_000):
        for source, block, release, deadline, slot in zip(*part, strict=True):
            assert (block, slot) == (done[source], end) and release <= slot < deadline
            done[source] += 1
            end += 1
            if end <= 120_000 and end % 97 == 0:  # no source has run out
                assert all(abs(done[s] - end * w / sum(weights)) < 1 for s, w in enumerate(weights))
    assert done == Counter(dict(enumerate(sizes)))


def test_many_sources_of_many_sizes():
    sizes = [1 + i * i % 23 for i in range(3000)]
    got = [row for part in mx.schedule(sizes, [n**0.5 for n in sizes]) for row in zip(*part, strict=True)]
    assert len({(r[0], r[1]) for r in got}) == len(got) == sum(sizes)
    assert [r[4] for r in got] == list(range(len(got))) and all(r[2] <= r[4] < r[3] for r in got)


def test_more_than_a_thousand_sources(as_docs):
    got = mx.mix(as_docs([(i, None, None, f"s{i % 1100}") for i in range(2500)]), block=2).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(2500)) and len({r.mix_pos for r in got}) == 2500
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_every_row_once_and_prefixes_near_the_targets(as_docs):
    rows = [(i, None, None, "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    weights = {"hot": 0.5, **{f"s{i}": 0.1 for i in range(5)}}
    got = mx.mix(as_docs(rows, "slot"), weights, block=4, quantum=100, rows_in_chunk=100).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(3000)) and len({r.mix_pos for r in got}) == 3000
    order = [r.source for r in sorted(got, key=lambda r: r.mix_pos)]
    done = Counter()
    for t, s in enumerate(order[:1200], 1):
        done[s] += 1
        assert all(abs(done[x] - t * w) <= 2 * 4 for x, w in weights.items())


def test_blocks_hold_one_source(as_docs):
    got = mx.mix(as_docs([(i, None, None, f"s{i % 3}") for i in range(100)]), block=5, quantum=30).collect()
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r.slot].add((r.source, r.block_no))
    assert all(len(x) == 1 for x in by_slot.values())
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_odd_rows(as_docs):
    got = mx.mix(as_docs(ODD, "block_no", "mix_pos"), block=2, quantum=50).collect()
    assert Counter(str(r.doc_id) for r in got) == Counter(str(r[0]) for r in ODD) and len({r.mix_pos for r in got}) == len(ODD)
    assert mx.mix(as_docs([])).collect() == []
    with pytest.raises(ValueError):
        mx.mix(as_docs([(i, None, None, str(i)) for i in range(5)]), quantum=3)
