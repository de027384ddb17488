from folioforge.llm import mail as M

SCHEMA = "extract_id long, original string, documents array<struct<title:string,text:string,ordinal:int>>, text string, ordinal int"
FIRST = "Hi John,\n\nThe quiet ledger outpaced a stale tariff for the better part of a year, and few readers noticed it at all.\nThe minutes of the last meeting say something rather different about the whole affair, I must admit.\n\nKind regards\nAnna Walters\nHead of Research\n\nSent from my phone"


def marked(text):
    return [i for i, (x, g) in enumerate(zip(text.split("\n"), M.not_new(text), strict=True)) if g and x.strip()]


def test_signature_device_and_greeting():
    assert marked(FIRST) == [5, 6, 7, 9]


def test_quoted_reply_wrapped_introduction_and_new_text_below():
    text = "On Fri, Mar 7, 2025 at 04:09 Anna Walters\n<anna@post.example> wrote:\n> Hi John,\n> a line that was\nwrapped out\n> of its mark\n\nHi Anna,\n\nBest, I think, is to wait for the audit.\nTo: be blunt, the chart is wrong.\n\nCheers,\nJohn"
    assert marked(text) == [0, 1, 2, 3, 4, 5, 12, 13]


def test_unmarked_history_runs_to_the_end():
    text = "Team,\n\nIf spread > 40 points, call me.\n\n________________________________\nFrom: Anna Walters\nSent: 24 Jan 2024\nTo: John\nSubject: The ledger\n\nHello all,\nOld words."
    assert marked(text) == [4, 5, 6, 7, 8, 10, 11]


def test_legal_text_banner_and_lookalikes():
    text = "CAUTION: external sender\n\nConfidentiality is the whole point of that chapter, so please keep the clause.\n\nDiese Nachricht ist vertraulich und nur für den Empfänger bestimmt.\nSollten Sie sie irrtümlich erhalten haben, löschen Sie sie bitte."
    assert marked(text) == [0, 4, 5]


def test_automata_find_unmarked_copies_of_earlier_mail(spark):
    later = "Hello all,\n\nSomething newly written stands here, with a thought of its own.\n\n" + "\n".join(FIRST.split("\n")[2:4])
    docs = [("a", FIRST, 0), ("Re: a", later, 1), ("x", None, 2)]
    rows = [(1, "inbox/a.MBOX", docs, "t", 3), (2, "inbox/b.txt", docs, "t", 3), (3, "inbox/c.eml", None, "t", 3), (4, "inbox/d.eml", [], "t", 3), (5, None, docs, "t", 3)]
    found = {(r.extract_id, r.ordinal, r.line_no) for r in M.lines_not_new(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(1, 0, 5), (1, 0, 6), (1, 0, 7), (1, 0, 9), (1, 1, 4), (1, 1, 5)}
    new = {(r.extract_id, r.ordinal): r.text for r in M.new_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert new[1, 1] == "Hello all,\n\nSomething newly written stands here, with a thought of its own."


def test_empty_table(spark):
    assert M.lines_not_new(spark.createDataFrame([], SCHEMA)).count() == 0


def thread(spark, *texts):
    rows = [(1, "a.mbox", [("t", x, i) for i, x in enumerate(texts)], "t", 3)]
    return {(r.ordinal, r.line_no) for r in M.lines_not_new(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_earlier_sentences_are_found_wherever_they_stand(spark):
    first = "Hello Tom,\n\nThe porter keeps the ledger under the stairs, and the keys hang in the pantry by the door.\nNobody has asked for either since the flood of that long and rainy spring."
    # run on from an unknown head line, wrapped anew, with no mark
    later = "Dear Bob,\n\nI shall look tomorrow.\n\nBetrifft unser Buch\nThe porter keeps the ledger under the\nstairs, and the keys hang in the pantry by the door. Nobody has asked\nfor either since the flood of that long and rainy spring.\n\nIs that so?"
    assert thread(spark, first, later) == {(1, 5), (1, 6), (1, 7)}
    # in the order of the file, only later messages repeat
    assert thread(spark, later.replace("Betrifft unser Buch\n", ""), first) == {(1, 2), (1, 3)}


def test_without_the_automata_copies_stay(spark, monkeypatch):
    first = "The porter keeps the ledger under the stairs, and the keys hang in the pantry by the door, says the cook."
    assert thread(spark, first, "New words.\n\n" + first) == {(1, 2)}
    monkeypatch.setattr(M, "patterns", lambda *_: [])
    assert thread(spark, first, "New words.\n\n" + first) == set()


def test_a_block_that_ends_two_messages_is_a_closing(spark):
    tail = "Ever thine in haste\nBartholomew of the lamps\nWarden below the bridge"
    assert thread(spark, f"One thing is written here.\n\n{tail}", "Another comes in between, by another hand.", f"Quite another is said there.\n\n{tail}") >= {(0, 2), (0, 3), (0, 4), (2, 2), (2, 3), (2, 4)}
    assert (0, 2) not in thread(spark, "One thing is written here.\n\nWe leave at noon\nand take the ferry\nif the wind allows", "Nothing more.")


def test_a_long_thread_and_a_long_legal_block(spark):
    texts = [f"Message {'x' * i} says that the {'y' * (i + 1)} of the house is kept by nobody at all, as far as one hears from the porter and his wife." for i in range(60)]
    assert thread(spark, *texts, "\n".join(texts)) == {(60, i) for i in range(60)}
    legal = "\n".join(["This message is privileged and confidential."] + ["It is meant for its addressee alone, line by line."] * 5000)
    assert len(thread(spark, "New words here.\n\n" + legal)) == 5001
