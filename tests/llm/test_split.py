import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tausift.llm.split import longest_unbroken, split_oversized, split_points


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc .,\n。ा　𝒳\r", max_size=300), st.integers(1, 60), st.data())
def test_pieces_cover_and_overlap(text, most, data):
    overlap = data.draw(st.integers(0, most - 1))
    pieces = split_points(text, most, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= most for a, b, _ in pieces)
    assert all(q[0] == p[1] - overlap and q[1] > p[1] for p, q in zip(pieces, pieces[1:]))
    assert (len(pieces) == 1) == (len(text) <= most)


def test_strongest_boundary_near_the_target():
    text = "a" * 40 + ". " + "b" * 10 + "\n\n" + "c" * 46
    (a, b, kind), (c, d, _) = split_points(text, 60, 0)
    assert (a, kind, text[b - 2 : b], c, d) == (0, "paragraph", "\n\n", b, 100)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 18), min_size=1, max_size=120), st.integers(0, 6))
def test_no_word_is_cut_in_half(sizes, overlap):
    text = " ".join("x" * n for n in sizes)
    assert all(kind != "none" for _, _, kind in split_points(text, 25, overlap))


def test_pieces_are_added():
    text = ("x" * 60 + " ") * 6
    pieces = split_points(text, 100, 10)
    assert len(pieces) == 6 and all(k in ("space", "end") for _, _, k in pieces)
    assert split_points(" ".join(["abcdefghi"] * 19), 100, 10)[0][2] == "space"


def test_balanced():
    sizes = [b - a for a, b, _ in split_points("word " * 200, 400, 0)]
    assert len(sizes) == 3 and max(sizes) - min(sizes) < 60


def test_marks_stay_with_their_letter():
    text = "क" + "ि" + "कि" * 30
    assert all(text[b : b + 1] != "ि" for _, b, k in split_points(text, 7, 0) if k == "none")


def test_unbroken():
    assert longest_unbroken("ab　cd。efg hi") == 3 and longest_unbroken("") == 0


def test_overlap_must_leave_room():
    with pytest.raises(ValueError):
        split_points("abc", 2, 2)


def test_table(spark):
    rows = [("a", "x" * 25, 10, 2, 1), ("b", "short", 10, 2, 1), ("c", None, 10, 2, 1), ("d", "y" * 30, None, 2, 1), ("e", "z z " * 10, 10, None, 1), ("a", "x" * 25, 10, 2, 1), (None, "w" * 11, 10, 0, 1)]
    df = spark.createDataFrame(rows, "id string, t string, m int, o int, piece int")
    got = split_oversized(df, "id", "t", "m", "o").collect()
    assert {r.id for r in got} == {"a", "e", None}
    a = sorted((r.piece_no, r.start, r.end) for r in got if r.id == "a")
    assert len(a) == 6 and all(r.piece == "x" * (r.end - r.start) and r.unbroken == 25 and r.n_pieces == 3 for r in got if r.id == "a")
    assert split_oversized(df.limit(0), "id", "t", "m", "o").count() == 0
