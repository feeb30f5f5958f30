import pytest

from tausift.llm.leaks import _own_texts, consistent_slots, leaked_items, opening_keys
from tausift.llm.tokens import tokens

NAMES = "Avora Belton Cirgan Dovell Emmark Folsto Grivan Hultor Ibsend Jorvik Kelman Lumbra".split()


def item(k, n=4):
    a = [NAMES[(k * 5 + j * 3) % 12] + "xyz"[k % 3] + str(k) for j in range(2 * n)]
    return " ".join(f"Near the old quay of {a[2 * j]} {10 + k + j} beekeepers painted driftwood boats called {a[2 * j + 1]} until the frost of {100 + 7 * k + j}." for j in range(n))


ITEMS = {k: item(k) for k in range(1, 9)}
INSTRUCTION = "Read the passage below and choose the answer."


@pytest.fixture
def found(spark):
    def run(texts, items=None):
        docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
        held = spark.createDataFrame(list((items or ITEMS).items()), "i long, x string")
        return {tuple(r)[:2] for r in leaked_items(docs, "d", "t", held, "i", "x").collect()}

    return run


def test_verbatim_part_and_layout(found):
    t = ITEMS[3]
    half = t[: int(len(t) * 0.55)]
    spoilt = t.upper().replace(" ", "  \n> ").replace("BOATS", "**BOATS**").replace("QUAY", "<i>quay</i>")
    wrapped = t.replace("boats", "boats\n\n- 84 -\n\n")
    altered = " ".join("word" if k % 14 == 7 else w for k, w in enumerate(t.split()))
    assert found(["ordinary text. " * 20 + t, half, spoilt, wrapped, altered]) == {(k, 3) for k in range(5)}


def test_no_leaks(found):
    t = ITEMS[3]
    others = t.replace("x3", "q9").replace("y3", "q9").replace("z3", "q9")
    assert found([None, "", t[: int(len(t) * 0.25)], INSTRUCTION, "Near the old quay of Zulip 5 beekeepers painted driftwood boats called Marro until the frost of 4."]) == set()
    numbers = "".join(str((int(c) + 3) % 10) if c.isdigit() and k % 2 else c for k, c in enumerate(others))
    assert found([numbers]) == set()  # the templates with other values


def test_two_items_in_one_document(found):
    assert found([ITEMS[1] + "\n\n" + "plain words " * 30 + ITEMS[2]]) == {(0, 1), (0, 2)}


def test_instructions_are_no_leak(spark, found):
    items = {k: f"{INSTRUCTION}\n{t}" if k < 5 else t for k, t in ITEMS.items()}
    own, _ = _own_texts(spark.createDataFrame(list(items.items()), "i long, x string"))
    assert not any(r.x.startswith("Read the passage") for r in own.collect())
    assert found([INSTRUCTION * 30, items[2][len(INSTRUCTION) :]], items) == {(1, 2)}


def test_japanese_with_inserted_blanks(found):
    base = "ムヴェルの古い桟橋の近くで、273人の提灯職人がシルナへ編み籠を運び、それは15年の霜まで続いた。リンノルを見下ろす段丘で、121人の提灯職人がフェドラの上空で鶴を数え、霧の674日間が過ぎた。"
    spaced = "　".join(base[k : k + 9] for k in range(0, len(base), 9))
    assert found([spaced], {1: base}) == {(0, 1)}
    assert tokens("シル　ナ、17　3日 ２０年") == ["シルナ", "173", "日", "20", "年"]


def test_long_instructions_are_no_leak(found):
    long = "Read the passage below. It was written long ago by a careful clerk. Answer all the questions. Choose one letter only. Write it into the box."
    items = {k: f"{long} {t}" for k, t in ITEMS.items()}
    assert len(opening_keys(items[1])) == 8 and found([long * 5, ITEMS[2]], items) == {(1, 2)}


WORD_PROBLEM = (
    "Avora has 12 baskets of pears and sells each basket to Belton for 30 coins. Belton keeps 4 of the baskets and gives the rest to Cirgan. "
    "Cirgan pays Belton 35 coins for each basket. How many coins does Belton earn if Avora wants 2 coins more from Cirgan and Cirgan refuses to pay Avora?"
)


def test_new_parameters(found):
    names = {"Avora": "Mirta", "Belton": "Jonas", "Cirgan": "Olwen", "12": "19", "30": "44", "35": "52", " 4 ": " 7 ", " 2 ": " 3 "}
    changed = WORD_PROBLEM
    for a, b in names.items():
        changed = changed.replace(a, b)
    mixed = changed.replace("Jonas earn", "Olwen earn").replace("if Mirta", "if Jonas").replace("for each basket. How", "for each basket. How").replace("pays Jonas", "pays Mirta").replace("from Olwen", "from Mirta")
    items = {**ITEMS, 50: WORD_PROBLEM}
    assert found(["words before it. " + changed, mixed, changed[: len(changed) // 4]], items) == {(0, 50)}
    assert found([changed.upper()], items) == {(0, 50)}


def test_slots_must_agree():
    slots = list(range(9))
    assert consistent_slots([1, 2, 1, 3, 2, 1, 3, 4], dict(enumerate([5, 6, 5, 7, 6, 5, 7, 8])), slots)
    assert not consistent_slots([1, 2, 1, 3, 2, 1, 3, 4], dict(enumerate([5, 6, 7, 7, 6, 5, 8, 8])), slots)
    assert not consistent_slots([1, 2, 3, 4], dict(enumerate([5, 6, 7, 8])), slots)  # nothing repeats, nothing shows


def test_copies_of_items(spark):
    docs = spark.createDataFrame([(1, ITEMS[1])], "d long, t string")
    items = spark.createDataFrame([*[(k, ITEMS[1]) for k in range(100, 160)], (1, ITEMS[2])], "i long, x string")
    assert {tuple(r)[:2] for r in leaked_items(docs, "d", "t", items, "i", "x").collect()} == {(1, k) for k in range(100, 160)}


def test_tables(spark):
    docs = spark.createDataFrame([(1, ITEMS[1], "a"), (1, ITEMS[1], "b"), (2, None, "a"), (3, "nothing", "a"), (4, ITEMS[2], "a")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*[(k, t) for k, t in ITEMS.items()], (1, ITEMS[1]), (99, None), (98, "")], "item_id long, text string")
    whole = {tuple(r)[:2] for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert whole == {(1, 1), (4, 2)}
    assert leaked_items(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaked_items(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("share,hit", [(0.3, False), (0.5, True)])
def test_two_fifths(found, share, hit):
    words = ITEMS[5].split()
    assert bool(found([" ".join(words[: int(len(words) * share)])])) == hit


@pytest.mark.parametrize("count", [8, 12])
def test_templates_of_many_items(found, count):
    def problem(k, start):
        names = {n: n + chr(97 + k) * 2 for n in ("Avora", "Belton", "Cirgan")} | {n: str(int(n) + start + 7 * k) for n in ("12", "30", "35")} | {" 4 ": f" {4 + start + k} ", " 2 ": f" {2 + start + k} "}
        text = WORD_PROBLEM
        for a, b in names.items():
            text = text.replace(a, b)
        return text

    items = {k: problem(k, 40) for k in range(count)}
    assert found(["words before it. " + problem(20, 500), problem(20, 500)[:80]], items) == {(0, k) for k in items}


def test_own_values_that_go_over_into_others(found):
    items = {k: item(k) for k in range(1, 13)}
    words, others = items[3].split(), item(40).split()
    at = int(len(words) * 0.46)
    assert found([" ".join(words[:at] + others[at:])], items) == {(0, 3)}
