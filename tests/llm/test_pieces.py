import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rivaq.llm import pieces as P


def parts(text):
    return [text[a:b] for a, b in P.sentences(text)]


def test_sentences():
    assert parts("Bir gün geldi. İkinci gün gitti!.. Üçüncü gün… Sonra?") == ["Bir gün geldi.", "İkinci gün gitti!..", "Üçüncü gün…", "Sonra?"]
    assert parts("«Kim geldi?» diye sordu Ali, sonra sustu. “Why?” asked she.") == ["«Kim geldi?» diye sordu Ali, sonra sustu.", "“Why?” asked she."]
    assert parts("Dr. Ali geldi (bkz. c. 3, s. 16). K. Veli no. 65 sandık vb. erzak aldı... öyle derler. It weighs 2.5 kg, cf. vol. 3, p. 73. When?") == ["Dr. Ali geldi (bkz. c. 3, s. 16).", "K. Veli no. 65 sandık vb. erzak aldı... öyle derler.", "It weighs 2.5 kg, cf. vol. 3, p. 73.", "When?"]
    assert parts("Âdet doğdu.Kuyumcu geldi;Sonra a.b.c gitti.\n- Madde bir\nBaşlık\n\n«Söz.» Dedi") == ["Âdet doğdu.", "Kuyumcu geldi;Sonra a.b.c gitti.", "- Madde bir", "Başlık", "«Söz.»", "Dedi"]
    assert parts("جاء الرجل. ذهب الولد؟ نعم") == ["جاء الرجل.", "ذهب الولد؟", "نعم"]
    assert parts("See p. 180.Beside the well.“Whose load?” asked Ali.\"Why?\" asked she. „Wer?“ Dann ging er.”Ja") == ["See p. 180.", "Beside the well.", "“Whose load?” asked Ali.", "\"Why?\" asked she.", "„Wer?“", "Dann ging er.”", "Ja"]
    assert parts("Box no. 2.Once upon.\nBox 17!..In 1.5 km. v2.0 is out. No. 7?Yes") == ["Box no. 2.", "Once upon.", "Box 17!..", "In 1.5 km. v2.0 is out.", "No. 7?", "Yes"]
    assert parts("") == parts(" \n\t ") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcÇİ .?!…\n-«»()0.,; ́")), max_size=400), st.integers(20, 120), st.integers(0, 15))
def test_pieces_cover_the_text(text, limit, overlap):
    spans = P.pieces(text, limit, overlap)
    assert all(b - a <= limit for a, b in spans)
    covered = set()
    for n, (a, b) in enumerate(spans):
        covered |= set(range(a, b))
        if n:
            assert spans[n - 1][1] - overlap <= a and spans[n - 1][1] < b
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_boundaries_are_natural():
    text = "Başlık bir\n" + "Bu cümle kısa sayılır. " * 8 + "\n\nBaşlık iki\n" + "- madde bir iki üç\n" * 6
    spans = P.pieces(text, 200, 0)
    assert [text[a:b].split("\n")[0] for a, b in spans][-1] == "Başlık iki"
    assert all(text[b - 1] in ".üç" or text[b : b + 1] in ("\n", "") for _, b in spans)


def test_tree_of_headings_lists_and_markup():
    text = "# A\nBir. İki.\n\n## B\nÜç.\n- x\n  - y\n  - z\n- w\n\n# C\nSon."
    at = {text[a:b]: path for path, (a, b) in P.leaves(text)}
    inside = lambda x, y: at[y][: len(at[x]) - 1] == at[x][:-1]
    assert at["Üç."][0] == at["Bir."][0] == at["# A"][0] and at["Üç."][1] == at["## B"][1] and at["Son."][0] not in at["# A"]
    assert inside("- x", "- y") and inside("- x", "- z") and not inside("- x", "- w")
    assert P.tree(text) == [[[[(0, 3)], [(4, 8), (9, 13)]], [[[(15, 19)], [(20, 23)], [[(24, 27)], [[(30, 33)]], [[(36, 39)]]], [[(40, 43)]]]]], [[[(45, 48)], [(49, 53)]]]]
    assert parts("<p>Son. Bir daha.</p><p>Yeni.</p>") == ["<p>Son.", "Bir daha.</p>", "<p>Yeni.</p>"]
    listed = {text[a:b] for text in ["<ul>\n<li>Bir.</li>\n<li>İki. Üç.</li>\n</ul>\nSon."] for _, (a, b) in P.leaves(text)}
    assert listed == {"<ul>", "<li>Bir.</li>", "<li>İki.", "Üç.</li>", "</ul>", "Son."}


def test_opens_only_what_is_too_large():
    """A subsection that fits stays whole although its section does not."""
    text = "# A\n" + "Uzun bir cümle burada. " * 6 + "\n## B\n" + "Alt bölüm cümlesi. " * 5 + "\n## C\n" + "Öteki alt bölüm. " * 6
    spans = [text[a:b] for a, b in P.pieces(text, 170, 0)]
    assert [s.split("\n")[0] for s in spans] == ["# A", "## B", "## C"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB. \n-#<p>/*1)")), max_size=200))
def test_leaves_are_the_sentences(text):
    assert [leaf for _, leaf in P.leaves(text)] == P.sentences(text)

    def flat(node):
        return [x for n in node for x in flat(n)] if isinstance(node, list) else [node]

    assert flat(P.tree(text)) == P.sentences(text)


def test_cut_values(spark):
    long = "Kelime kelime geldi. " * 60
    rows = [("a", long, None, "x"), ("a", long, None, "x"), ("b", "kısa" + " " * 2000, long.strip() + " " * 9, "x"), ("c", "y" * 5000, "", "x"), ("d", None, "z" * 800, "x")]
    df = spark.createDataFrame(rows, "id string, tr string, en string, metin string")
    got = P.cut(df, "id", ["tr", "en"]).collect()
    assert {(r.id, r.alan) for r in got} == {("a", "tr"), ("b", "en"), ("c", "tr")}
    text = {("a", "tr"): long, ("b", "en"): rows[2][2], ("c", "tr"): "y" * 5000}
    for r in got:
        assert r.parca == text[r.id, r.alan][r.bas : r.son] and len(r.parca) <= 800
    found = {(r.id, r.alan, r.konum) for r in P.found(df).collect()}
    assert len([x for x in found if x[0] == "a"]) == 60 and ("c", "tr", 0) in found
    assert found == {(k, c, m.start()) for (k, c), t in text.items() for m in re.finditer(r"Kelime|^y", t)}
    assert P.found(df.limit(0)).count() == 0
