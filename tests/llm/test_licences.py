from tallyframe.llm import licences

DOC = "doc_id long, text string, digest string, licence string"


def test_canonical_forms(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Jo\n(c) others\n" + licences.MIT.replace(" ", "\n ", 9).upper()
    data = [(1, mit, "", ""), (2, licences.BSD_HEAD.replace("copyright", "Copyright") + licences.BSD_TAIL.replace("HOLDERS", "owners"), "", ""),
            (3, "words\n  released under the MIT Licence!\nLicensed under CC BY-NC 4.0.\n", "", ""), (4, licences.MIT + " and more", "", ""),
            (5, None, "", ""), (6, "", "", ""), (7, "Licenced under the Apache License, v2.0", "", ""),
            (3, "words\n  released under the MIT Licence!\nLicensed under CC BY-NC 4.0.\n", "", ""), (None, "This work is licensed under the\r\nGNU General Public License, version 3.", "", "")]
    got = licences.scan(spark.createDataFrame(data, DOC)).collect()
    assert len(got) == len(data)
    by_id = {r["doc_id"]: (r["licence"], r["notices"]) for r in got}
    assert by_id[1][0] == "MIT" and by_id[2][0] == "BSD-2-Clause" and by_id[3] == (None, "CC-BY-NC-4.0,MIT")
    assert by_id[4] == (None, "") and by_id[5] == by_id[6] == (None, "") and by_id[7] == ("Apache-2.0", "Apache-2.0")
    assert by_id[None][0] == "GPL-3.0"
    assert licences.scan(spark.createDataFrame([], DOC)).count() == 0


def test_list_has_one_licence_per_digest(spark):
    known = licences.known_digests(spark)
    assert known.count() == known.select("known").distinct().count() <= len(licences.LICENCES)
    assert len({n for n, _ in licences.LICENCES}) < 64


def test_wrapped_sentences_quotes_and_full_texts(spark):
    import textwrap
    texts = dict(licences._texts()[::-1])  # the whole texts come last
    wrapped = licences.ISC.replace("above copyright", "above\ncopyright")
    curly = licences.MIT.replace('"Software"', "“Software”").replace('"AS IS"', "“AS\u00a0IS”").replace(", EXPRESS", " — EXPRESS")
    filled = texts["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 The Authors")
    data = [(1, wrapped, "ISC"), (2, "Copyright 2020 Jo\n\n" + wrapped, "ISC"), (3, curly, "MIT"), (4, "• " + licences.ZLIB.replace("'", "’"), "Zlib"),
            (5, filled, "Apache-2.0"), (6, " ".join(texts["Apache-2.0"].split(licences.END)[0].split()), "Apache-2.0"),
            (7, "Copyright Jo Doe\n\n" + licences.MIT, "MIT"), (8, "© Jo\n(c) Al\n(c) others\n" + licences.MIT, "MIT")]
    for k, name in enumerate(("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense")):
        data.append((20 + k, texts[name], name))
    narrow = textwrap.fill(texts["Apache-2.0"].split(licences.END)[0].replace("(c) You", "\n(c) You"), 24, replace_whitespace=False, break_long_words=False)
    data.append((30, narrow, "Apache-2.0"))
    got = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame([(i, t, "", "") for i, t, _ in data], DOC)).collect()}
    assert got == {i: want for i, _, want in data}


def test_given_licence_texts(spark):
    own = spark.createDataFrame([(f"Own-{i:03}", f"Own licence number {i}") for i in range(99)] + [("none", "")], "licence string, text string")
    docs = spark.createDataFrame([(1, "own LICENSE, number 98", "", ""), (2, "x\n\nOwn licence number 7.\nown licence number 5", "", ""),
                                  (3, licences.MIT, "", ""), (4, None, "", "")], DOC)
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licences.scan(docs, licence_texts=own).collect()}
    assert got == {1: ("Own-098", "Own-098"), 2: (None, "Own-005,Own-007"), 3: (None, ""), 4: (None, "")}
