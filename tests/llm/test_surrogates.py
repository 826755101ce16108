"""The whole mapping of surrogates against brute force: distinct, alike, never an entity."""

import random
import time

import pytest

from tests.llm.corpora import AWKWARD, frame
from tidewater.llm import surrogates

KEY = b"a key of the tests"
DENSE = [f"{i}@gmail.com" for i in range(10)] + ["_@gmail.com", "%%@gmail.com", "名前@example.com"] + [f"192.168.7.{i}" for i in range(256)]


def _texts():
    rng = random.Random(8)
    mails = [f"{rng.choice('abc')}{rng.randrange(30)}@example.com" for _ in range(40)]
    phones = [f"+1 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}" for _ in range(10)]
    names = ["Mrs. Anna Schmidt", "Mr. Karl Vogel", "Dr. Vogel", "Госпожа Анна"]
    pool = mails + phones + names + DENSE
    rows = [(1000 + i, " ; ".join(rng.choices(pool, k=6))) for i in range(200)] + [(5000 + i, f"only {x} here") for i, x in enumerate(pool)]
    return rows + [r for r in AWKWARD if r[0] not in (None, 11)]


def _replaced(before, after):
    """Pairs (kind, canonical, what a text shows instead) of one text, from both versions."""
    out, shift = [], 0
    found = surrogates.mentions(before)
    ends = [e for _, e, *_ in found]
    for (s, e, kind, _, entity), later in zip(found, [m[0] for m in found[1:]] + [len(before)]):
        gap = before[e:later]
        start = s + shift
        stop = len(after) if later == len(before) and not gap else after.index(gap, start) if gap else None
        if later == len(before) and gap:
            stop = len(after) - len(gap)
        out.append((kind, entity, after[start:stop]))
        shift += (stop - start) - (e - s)
    assert ends is not None
    return out


@pytest.mark.parametrize("most", [10**6, -1])
def test_the_whole_mapping(spark, monkeypatch, most):
    monkeypatch.setattr(surrogates, "BROADCAST_EXCEPTIONS", most)
    rows = _texts()
    found = {r.doc_id: r for r in surrogates.replace_entities(frame(spark, rows), KEY).collect()}
    assert sorted(found) == sorted(i for i, _ in rows)
    new: dict = {}
    for i, text in rows:
        ones = surrogates.mentions(text or "")
        assert found[i].n_entities == len(ones) and (ones or found[i].text == text)
        for kind, entity, shown in _replaced(text, found[i].text) if ones else []:
            if kind == "phone":
                shown = "".join(c for c in shown if c.isdigit())
            assert new.setdefault((kind, entity.partition(":")[2] if kind == "name" else entity), shown) == shown
    real = {("".join(c for c in e if c.isdigit()) if k == "phone" else e) for k, e in new}
    assert len({(k, s) for (k, _), s in new.items()}) == len(new)  # distinct
    assert not {s.lower() for s in new.values()} & {r.lower() for r in real}  # none is an entity


def test_other_keys_give_other_surrogates():
    one, two = (surrogates.surrogate(k, "email", "someone@example.com") for k in (b"k", b"l"))
    assert one != two and one.endswith("@example.com")
    with pytest.raises(ValueError, match="key"):
        surrogates.replace_entities(None, b"")


def test_long_locals_change_throughout():
    local = "x" * 400
    new = surrogates.surrogate(KEY, "email", f"{local}@gmail.com").partition("@")[0]
    assert len(new) == 400 and all(new[i : i + 24] != "x" * 24 for i in range(0, 400, 24))


@pytest.mark.parametrize("body", ["a" * 1_000_000 + "@", "a." * 400_000 + "@x", "1 " * 200_000, "token=" * 150_000, "Anna " * 100_000 + "Mr. Anna", "a@" * 300_000, ":a" * 300_000 + "1"])
def test_long_texts_take_linear_time(body):
    began = time.thread_time()
    surrogates.mentions(body)
    whole = time.thread_time() - began
    began = time.thread_time()
    surrogates.mentions(body[: len(body) // 8] + body[-1:])
    assert whole < 30 * (time.thread_time() - began) + 2


def test_no_documents(spark):
    none = frame(spark, AWKWARD).where("false")
    assert surrogates.replace_entities(none, KEY).count() == 0


def test_genders_and_coreference(spark):
    rows = [(1, "Mrs. Anna Schmidt met Anna Schmidt's aunt. Later Mr. Schmidt came.")]
    text = surrogates.replace_entities(frame(spark, rows), KEY).first().text
    given, last = text.removeprefix("Mrs. ").split(" met ")[0].split(" ")
    assert given.endswith("ia") and f"met {given} {last}'s aunt" in text and f"Mr. {last} came" in text
