"""Restoration of disguised words, scoring, and held-out accuracy on made-up labels."""

from codestrata.llm import toxicity as tx


def weigher(known=("the", "cook", "sheet", "wall", "river", "council", "duck")):
    weights = {w: 6.0 for w in tx.STRONG} | {w: 2.0 for w in tx.COMPANY}
    model = tx.CharacterModel({w: 1.0 for w in known} | {w: 3.0 for w in weights})
    return tx.Weigher(weights, set(known), model)


def test_restoration():
    w = weigher()
    for token in ("fucking", "fuck1ng", "whorc", "wh0re,", "basfard", "b1tch", "stlnking", "f.u.c.k", "shiiiit", "5lut", "“cunt”", "vvhore", "fuckinq"):
        assert w[token] is not None, token
    for token in ("the", "sheet", "duck", "wall", "council", "12", "", "...", "class", "shift", "cottage"):
        assert w[token] is None, token
    assert w["b——d"][0] == "b*d" and w["w——e"] is not None and w["x——q"] is None


def test_filter_passes_every_reading():
    words = [w for w in tx.STRONG + tx.COMPANY if len(w) >= 3]
    readable = tx.Readable(words)
    for word in words:
        assert word in readable
        for k, c in enumerate(word):
            singles = [x for x, readings in tx.READINGS.items() if c in readings] + [pair for pair, one in tx.MERGED.items() if one == c]
            for x in (*singles, *(c + sign for sign in tx.SEPARATORS), c + c):
                assert word[:k] + x + word[k + 1 :] in readable, (word, k, x)
    assert not any(w in readable for w in ("council", "river", "xyzzy", "12", "..."))
    w = weigher()
    for token, word in (("fiick", "fuck"), ("wliore", "whore"), ("curit", "cunt"), ("bitcli", "bitch"), ("6itch", "bitch"), ("6astard", "bastard"), ("drnnken", "drunken")):
        assert w[token] is not None and w[token][0] == word, token


def test_digits_and_signs_are_not_limited():
    w = weigher()
    for token, word in (("5h1t", "shit"), ("wh0r3", "whore"), ("n1gg3r", "nigger"), ("b1tch3s", "bitches"), ("a55hole", "asshole"), ("$h1t", "shit")):
        assert w[token] is not None and w[token][0] == word, token
    for token in ("7175", "1755", "$455", "5417", "1st", "75th", "sbif"):  # numbers, and letters beyond the limit
        assert w[token] is None, token


def test_tokens_of_any_length():
    w = weigher()
    for token in ("sh" + "i" * 100_000 + "t", "f" + "." * 60 + "u.c.k", "w-h-o-r-e" + "-" * 5_000, "fuuuuu" + "u" * 50 + "ck!"):
        assert w[token] is not None, token[:20]
    for token in ("x" * 1_000_000, "ab" * 200_000, "s" * 300_000, "4" * 100_000, "http://" + "a/b." * 50_000):
        assert w[token] is None


def test_own_words():
    weights = {"bitch": 2.0, "cock": 2.0}
    model = tx.CharacterModel({"bitch": 3.0, "cock": 3.0, "the": 50.0})
    assert tx.own_words({"bitcli": 40, "bitch": 30, "eock": 1, "cock": 3}, weights, model) == {"bitcli"}
    assert tx.own_words({"bitcli": 2, "bitch": 300}, weights, model) == set() and tx.own_words({}, weights, model) == set()


def test_corpus_statistics(spark):
    documents = spark.createDataFrame([(1, "Whore, wh0re whore w\u00e4r c\u014dck"), (2, None), (3, "")] * 2, "doc_id long, text string")
    counts, triples = tx.corpus_statistics(documents, {"whore": 6.0})
    assert counts == {"whore": 4} and triples["^^w"] == 6 and triples["re$"] == 4 and "oc\u014d" not in triples
    more, _ = tx.corpus_statistics(documents.unionByName(documents), {"whore": 6.0})
    assert more == {"whore": 8, "wh0re": 4}
    assert tx.corpus_statistics(documents.where("false"), {"whore": 6.0}) == ({}, {})


def test_scores():
    w = weigher()
    assert tx.score(None, w) == tx.score("", w) == tx.score(" \n ", w) == 0.0
    assert tx.score("The council met by the river.", w) == 0.0
    assert tx.score("you fuck-\ning thief", w) >= 4.2
    assert tx.score("s h i t of a man here", w) >= 4.2
    far = "filthy " + "x1 " * 200 + "swine"
    near = "filthy swine of a cur"
    assert tx.score(far, w) < tx.score(near, w)
    assert tx.score("river " * 100_000 + "whore", w) >= 4.2


def test_learned_weights_and_rates(spark):
    clean = ["The council met at the river and the cock crowed.", "A bastard file was stolen.", "Wheat and oats were sold."]
    bad = ["You stinking swine, we will slit your throat and zorble.", "That filthy cur zorbles, zorble him.", "Zorble the whole brood, you filthy whore."]
    docs = [(k, t, "s" if k % 2 else None, "x") for k, t in enumerate(clean * 40 + bad * 20)] + [(999, None, "s", "x"), (1000, "", "s", "x")]
    labels = [(k, "r", int(k >= 120), 1) for k in range(180)] + [(5, "q", None, 1), (None, "q", 1, 1), (7, "q", 1, 1), (5555, "q", 1, 1)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, annotator string, toxic int, text int")
    weights = tx.learn(documents, marks)
    assert weights["zorble"] > 0.5 and weights.get("council", 0) == 0 and weights["whore"] > 4
    scored = {r.doc_id: r.toxic for r in tx.score_documents(documents, marks).collect()}
    assert all(scored[k] == (k >= 120) for k in range(180)) and not scored[999] and not scored[1000]
    rates = {r.source: (r.documents, r.found) for r in tx.rates(tx.score_documents(documents, marks)).collect()}
    assert sum(f for _, f in rates.values()) == 60 and set(rates) == {"", "s"}
    assert tx.score_documents(documents.where("false"), marks.where("false")).count() == 0
