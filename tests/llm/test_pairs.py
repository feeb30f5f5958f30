import datetime as dt
import random

import pytest

from tausift.llm.pairs import is_copied, is_empty, is_refusal, is_wrong_language, language_of, list_incomplete, needs_statistics, open_structures, pair_defects, says_missing, structure_defect, tiling

IT, JA, HI = "Qual è stato il fatturato di Banca Zerta nel 2024?", "ゼルタ商事の売上高はいくらですか。", "ज़ेरेफे लिमिटेड की आय कितनी थी?"


@pytest.mark.parametrize("t", [None, "", " ", "​", "...", "* ", "None", "N/A", "null", '""', "```\n```", "<p></p>", "&nbsp;", "[]", "**", "。", '{"content": ""}'])
def test_empty(t):
    assert is_empty(t)


@pytest.mark.parametrize("t", ["0", "5", "懲役9月", "9 mesi", "<p>x</p>"])
def test_not_empty(t):
    assert not is_empty(t)


def test_parser():
    assert open_structures('a (b [c] "d" e') == ["("] and open_structures("```\ncode (") == ["```"] and open_structures('{"a": "b') == ["{", '"']
    assert open_structures("it's 5) fine «x» (y) “z”") == [] and open_structures("<b>x") == ["<b"] and open_structures("**x** and **y") == ["**"]


@pytest.mark.parametrize("t", ["I punti sono tre:\n1. Uno.\n2. Due.", "要点は次の三つである。\n- 一。\n-", "I punti principali sono tre:\n", "मुख्य बातें तीन हैं:\n1. एक।", "La corte ha esaminato a lungo tutte le questioni sollevate dalle parti nel corso del giudizio di appello. I punti principali sono tre:\n1. Uno.\n2. Due.", "I punti sono tre:\n1. Uno.\n\nFine del testo."])
def test_lists_that_stop(t):
    assert list_incomplete(t)


@pytest.mark.parametrize("t", ["I punti sono tre:\n1. Uno.\n2. Due.\n3. Tre.", "Tre giorni dopo.", "1. Uno.\n2. Due.", "要点は次の三つである。\n- 一。\n- 二。\n- 三。", "1. Uno.\n2. Due\nche continua.", "I punti sono due:\n1. Uno.\n2. Due.\n\nFine del testo."])
def test_lists_that_hold(t):
    assert not list_incomplete(t)


@pytest.mark.parametrize("t", [IT, IT.upper(), f"Domanda: {IT}", f"<p>{IT}</p>", f'{{"content": "{IT}"}}', f"{IT}\n{IT}", IT.replace(" ", "  "), IT[:-1], f"{IT} " * 400, f"{IT} " * 400 + IT[:24], f"Domanda: {IT}\n" * 300])
def test_copied(t):
    assert is_copied(t, IT)


@pytest.mark.parametrize("t,q", [(f"{IT} 9 milioni", IT), ("Nel 2024 Banca Zerta ha fatturato 9 milioni.", IT), (f"「{JA[:-1]}」について、", JA), (f"「{JA[:-1]}」について、7億円", JA), ("7億円", JA), ("", IT), (f"{IT} " * 400 + "Sono 9 milioni.", IT)])
def test_not_copied(t, q):
    assert not is_copied(t, q)


def test_copied_japanese():
    assert is_copied(f"「{JA}」というご質問ですね。", JA) and is_copied(f"質問：{JA}", JA)
    assert is_copied(f"「{JA}」というご質問ですね。" * 200, JA) and is_copied(f"質問：{JA}" * 200, JA) and not is_copied(f"質問：{JA}" * 200 + "懲役七月でした。", JA)
    assert not is_copied(f"「{JA}」について、7億円", JA)


def test_tiling_is_greedy():
    def brute(a, q, least):
        best = [0] * len(a)
        for i in range(len(a)):
            for j in range(len(q)):
                k = 0
                while i + k < len(a) and j + k < len(q) and a[i + k] == q[j + k]:
                    k += 1
                best[i] = max(best[i], k)
        return [any(best[i] >= max(least, k - i + 1) for i in range(k + 1)) for k in range(len(a))]

    rng = random.Random(4)
    for _ in range(300):
        a, q = [rng.choice("abc") for _ in range(rng.randint(1, 25))], [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        marked, used = tiling(a, q, 2)
        covered = brute(a, q, 2)
        assert all(c for m, c in zip(marked, covered) if m) and used <= len(q)
        for k in range(len(a) - 1):  # no two free neighbours could still be a tile
            assert marked[k] or marked[k + 1] or "".join(a[k : k + 2]) not in "".join(q)


@pytest.mark.parametrize(
    "t",
    [
        "Mi dispiace, ma non posso rispondere.", "In quanto assistente virtuale preferisco non commentare. Posso aiutarla con altro?", "Mi è impossibile rispondere.", "申し訳ありませんが、この件についてお答えできません。専門家にご相談ください。",
        "この件についてコメントを差し控えます。", "माफ़ कीजिए, इस प्रकरण पर जानकारी देने की मुझे अनुमति नहीं है।", "I'm sorry, but I can't help with that.", "誠に残念ながら、こうした内容はお力になれません。ご了承ください。",
        "Mi dispiace, ma non posso rispondere. " * 40, "Mi dispiace, ma non posso rispondere. " * 2000,
    ],
)
def test_refusal(t):
    assert is_refusal(t) and structure_defect(t, IT, "factual") == "refusal"


@pytest.mark.parametrize("t", ["Il testimone non ha voluto rispondere.", "証人は答えることを拒否した。", "Ha respinto la proposta, scusandosi con i soci.", "Nel 2024 ha fatturato 9 milioni. La data non è indicata nel testo.", "提案を断り、申し訳ないと述べた。"])
def test_reports_are_no_refusal(t):
    assert not is_refusal(t)


def test_missing_information():
    for t in ("L'informazione non è presente.", "該当する情報は見当たりません。", "ऐसी कोई जानकारी नहीं मिली।"):
        assert says_missing(t) and structure_defect(t, IT, "unanswerable") is None
    for t in ("233 milioni di euro La data esatta non è indicata nel testo.", "懲役14月詳細な日付は資料に記載がない。", "22 महीने सही तारीख़ दस्तावेज़ में नहीं दी गई है।"):
        assert not says_missing(t) and structure_defect(t, IT if t[0] == "2" and "euro" in t else HI if "महीने" in t else JA, "factual") is None
    assert says_missing("L'informazione non è presente. Non risulta. Dal testo non è possibile saperlo.")
    assert structure_defect(None, IT, "unanswerable") is None and structure_defect("", IT, "factual") == "empty"


def test_languages():
    assert [language_of(t) for t in (IT, JA, HI, "该公司亏损460万元，并把分红推迟到下一年。", "La empresa perdió dinero y aplazó el pago hasta el año siguiente.")] == ["it", "ja", "hi", "zh", "es"]
    assert is_wrong_language("The accused was sentenced to 22 months for fraud.", IT) and is_wrong_language("由于海外销售，收入增长了35%。", JA) and is_wrong_language("Le chiffre d'affaires a augmenté grâce aux ventes.", HI)
    assert not is_wrong_language("懲役9月", JA) and not is_wrong_language("Nel 2024 株式会社トゥカ ha fatturato 9 milioni di euro.", IT) and not is_wrong_language("7億円 (Ref. Nollin Annual Report, Sec. 7)", JA)


@pytest.mark.parametrize("t", ["La rete del settore e (", "Il consiglio ha rifiutato e", "ha fatturato 3 milioni di ..", "contratto del [...]", "rinviato, ", '{"content": "Il consiglio ha'])
def test_truncated(t):
    assert structure_defect(t, IT, "factual") == "truncated"


@pytest.mark.parametrize("t", ["9 mesi di reclusione", "È passata a Zernol S.r.l..", "Il 96%.", "वादी ने 5 रुपये की माँग की।", "Fine (Ref. X, Sec. 7)"])
def test_not_truncated(t):
    assert structure_defect(t, HI if "की" in t else IT, "factual") is None


def test_ends_that_need_counts():
    assert needs_statistics("Fine.") is None and needs_statistics("Fine (Ref. X)") == "Fine" and needs_statistics("Fine. (Ref. X)") is None


def test_table(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(f"q{k}", IT, f"Il consiglio ha respinto la proposta di Banca Zerta{k} nel {k}.", "9 mesi di reclusione", "factual", t, ["La corte ha deciso."], "x") for k in range(20)]
    rows += [
        ("cut", IT, "Il consiglio ha respinto la proposta di", "Il consiglio ha respinto la prop", "factual", t, None, "x"),
        ("open", IT, "Il consiglio ha respinto la proposta di Banca Zerta7 nel 7", "Il consiglio ha respinto", "factual", t, None, "x"),
        ("none", None, None, None, None, None, None, None),
        ("echo", IT, f"{IT[:-1]}? 9 milioni di euro", "9 milioni di euro", "factual", t, [], "x"),
        ("un", IT, None, "L'informazione non è presente.", "unanswerable", t, [], "x"),
        ("old", IT, None, "9 mesi di reclusione", "factual", t, [], "x"),
        ("old", IT, "9 mesi di reclusione", "9 mesi di reclusione", "factual", t + dt.timedelta(days=1), [], "x"),
        (None, IT, None, None, "factual", t, [], "x"),
        ("long", IT, "Il consiglio ha respinto la proposta. " * 3000, "9 mesi di reclusione", "factual", t, [], "x"),
    ]
    df = spark.createDataFrame(rows, "query_id string, question string, answer string, generated_answer string, query_type string, written_at timestamp, refs array<string>, defect string")
    got = {(r.query_id, r.field_name): r.defect for r in pair_defects(df, "query_id", "question", ["answer", "generated_answer"], "query_type", "written_at", ["refs"]).collect()}
    assert got == {("cut", "answer"): "truncated", ("cut", "generated_answer"): "truncated", ("open", "generated_answer"): "truncated", ("none", "answer"): "empty", ("none", "generated_answer"): "empty"}
    assert pair_defects(df.limit(0), "query_id", "question", ["answer"], "query_type", "written_at").count() == 0


def test_copies_of_a_cut_text_are_no_evidence(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(f"q{k}", IT, f"Il consiglio ha respinto la proposta di Banca Zerta{k} nel {k}.", "factual", t) for k in range(20)]
    rows += [(f"cut{k}", IT, "La corte di Roma ha poi deciso che il consiglio ha respinto", "factual", t) for k in range(30)]
    df = spark.createDataFrame(rows, "query_id string, question string, answer string, query_type string, written_at timestamp")
    got = {r.query_id: r.defect for r in pair_defects(df, "query_id", "question", ["answer"], "query_type", "written_at").collect()}
    assert got == {f"cut{k}": "truncated" for k in range(30)}
