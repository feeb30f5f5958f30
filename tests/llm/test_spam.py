import pytest

from tausift.llm.spam import keyword_pages, line_shape, spam_share

SENTENCE = "The auditor qualified its opinion on how inventories were valued."


@pytest.mark.parametrize(
    "page",
    [
        "\n".join(f"https://a{k}.example/x/{k}" for k in range(6)),
        "\n".join(f"* [best loan {k}](https://a{k}.example/x)" for k in range(6)),
        "\n".join(f"{k}) ナル – a{k}.example/x/{k}" for k in range(6)),
        "\n".join(f"Mutu pabo / SKU-{k}911 / XL / insurance" for k in range(6)),
        "\n".join(f"cheap loan ({k * 7})" for k in range(8)),
        " ".join(f"#tag{k % 5}" for k in range(30)),
        "loan cheap loan best price cheap loan best price " * 5,
        "\n".join(["Omom mumu", "breach Reom 2016", "Reom breach", "Vozer mumu", "Omom breach", "Reom mumu 2019"]),
        " | ".join(["insurance", "loan", "retail", "loan"] * 6),
        " · ".join(["公式通販", "副業", "比較"] * 8),
        " ".join(f'<a href="https://x.example/{k}">offer</a>' for k in range(8)),
        SENTENCE + "\n" + "\n".join(f"https://a{k}.example/x/{k}" for k in range(9)),
        "offers in Zerta: offers and offers discount for offers with offers. " * 6,
        "appropriazione indebita a Tabo: appropriazione indebita, appropriazione\nindebita mufe e appropriazione indebita per\nappropriazione indebita. " * 4,
        "なら不動産、ヴェルオムの不動産は不動産の不動産へ。不動産クーポンで不動産。" * 5,
        "बीमा के लिए बीमा, मुवो में बीमा बीमा बीमा यहाँ बीमा। " * 5,
        "Cheap loans best loans online loans compare cheap loans fast loans free loans discount loans online.",
        "Cheap loans.\nBest loans.\nFast loans.\nCheap credit.\nBest credit.\nFast credit.",
        "Cheap loans:\nBest loans:\nFast loans:\nCheap credit:\nBest credit:\nFast credit:",
        "loans, cheap loans, best loans, credit, cheap credit, best credit, loans online.",
        "不動産 保険 格安ローン 無料査定。\n保険 不動産 無料査定 比較。\n格安ローン 保険 比較 不動産。",
        "\n".join("#loans #cheap #fast #credit #offer Get it now." for _ in range(5)),
        "\n".join(f"{k}. https://a{k}.example/x/{k}" for k in range(1, 9)),
        "\n".join(f"[{k}] https://a{k}.example/x/{k}" for k in range(1, 9)),
        "\n".join(f"best-loans{k}.example.com" for k in range(8)),
    ],
)
def test_spam(page):
    assert spam_share(page)[0] > 0.5


@pytest.mark.parametrize(
    "page",
    [
        "",
        " \n​",
        SENTENCE * 5,
        "\n".join(f"{k}. {SENTENCE}" for k in range(6)),
        "| | 2004 | 2005 |\n|---|---|---|\n" + "\n".join(f"| retail | {k}00 | {k}5 |" for k in range(6)),
        "\n".join(f"- retail: Zerta Group, {k}04" for k in range(8)),
        SENTENCE * 3 + "\n" + "\n".join(f"[{k}] https://a{k}.example/x/{k}" for k in range(9)),
        "# Background\n" + SENTENCE,
        "The board met in\nZerta and the board\nagreed that the board\nof Zerta would be the\nboard. The plant ran on\nand the plant of Zerta\nran at the plant.",
        SENTENCE * 6 + "\n" + "\n".join(["Omom mumu", "Reom mumu", "Omom mumu"]),
    ],
)
def test_no_spam(page):
    assert spam_share(page)[0] <= 0.5


def test_shapes():
    assert line_shape("   ")[0] == "blank" and line_shape("## Results")[0] == "heading" and line_shape("[3] https://a.example/b")[0] == "reference"
    assert line_shape("कंपनी पर ऋण है।")[0] == "sentence"


def test_tags_of_many_shapes():
    words = "insurance loan retail offer price credit broker fund mortgage".split()
    lists = [mark.join(words[:n]) for n in range(3, 10) for mark in (", ", " | ", " / ", " · ")]
    share, shapes = spam_share("\n".join([SENTENCE] * 6 + lists))
    assert share > 0.6 and len(shapes) == 28


def test_long_page_is_read_whole():
    assert spam_share(SENTENCE * 50 + "\n" + "\n".join(f"https://a{k}.example/x/{k}" for k in range(4000)))[0] > 0.9


def test_table(spark):
    df = spark.createDataFrame([(1, "#a #b #a #b #a #b", 1), (2, None, 1), (3, "", 1), (1, "#a #b #a #b #a #b", 2)], "id long, t string, spam_share int")
    got = sorted((r.id, r.is_spam) for r in keyword_pages(df, "id", "t").collect())
    assert got == [(1, True), (1, True), (2, False), (3, False)]
    assert keyword_pages(df.limit(0), "id", "t").count() == 0
