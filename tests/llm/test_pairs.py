import pytest

from adit.llm.pairs import Ends, asked, defect, defects, language, learnt_ends

ENDS = Ends(frozenset(["e.g.", "i.e."]))
PROMPT = "CVE ID: CVE-2020-1\nTitle: Quiet Beacon\nDescription: The reporting team noticed odd entries in the session broker: 24 failures within 545 minutes."
ASK = "What should be done first, and why?"
CASES = [
    (ASK, PROMPT, None, "empty"),
    (ASK, PROMPT, " ​\n", "empty"),
    (ASK, PROMPT, "# Assessment\n\n## Details\n\n## Next steps\n", "empty"),
    (ASK, PROMPT, "```\n```", "empty"),
    (ASK, PROMPT, "[output]", "empty"),
    (ASK, PROMPT, "(no answer)", "empty"),
    (ASK, None, "No.", None),
    (ASK, PROMPT, "I’m sorry, but I can’t help with that. Please contact the vendor instead.", "refusal"),
    (ASK, PROMPT, "## Assessment\n\nEs tut mir leid, dabei kann ich nicht helfen.", "refusal"),
    (ASK, PROMPT, "I cannot overstate how urgent this is. Update the broker at once.", None),
    (ASK, PROMPT, "Operators who are unable to update should act as follows. Restart it.", None),
    (ASK, PROMPT, ASK.upper(), "copy"),
    (ASK, PROMPT, f"Question: {ASK}\n\n{PROMPT}...", "copy"),
    (ASK, PROMPT, "  ".join(PROMPT.split(" ")), "copy"),
    (ASK, PROMPT, "## Details\n" + PROMPT.split(": ", 3)[-1] + "\n\n**Next steps:**\n- Restart the broker and rotate all of its keys, since the entries point at a leak of them.", None),
    (ASK, PROMPT, "Restart the broker. Then rotate all", "truncated"),
    (ASK, PROMPT, "Restart the broker, e.g.", "truncated"),
    (ASK, PROMPT, "Restart the broker.\n\n```\nctl --now", "truncated"),
    (ASK, PROMPT, "Restart the broker.\n\n```\nctl --now\n```", None),
    (ASK, PROMPT, "Restart the broker.\n- CWE IDs: CWE-2069, CWE-2436", None),
    (ASK, PROMPT, "Restart the broker.\n- CWE IDs: CWE-2069, CWE-24", "truncated"),
    (ASK, PROMPT, "Restart the broker.\n\nMore: https://docs.example.org/cve-1", None),
    (ASK, PROMPT, "Do it in three ways:", "truncated"),
    (ASK, PROMPT, "Restart it.\n2.", "truncated"),
    (ASK, PROMPT, "Starten Sie den Dienst neu und prüfen Sie das Protokoll.", "language"),
    (ASK + " Answer in German.", PROMPT, "Starten Sie den Dienst neu und prüfen Sie das Protokoll.", None),
    ("Что нужно сделать сначала и почему?", PROMPT, "Restart the service and check what is in the log.", "language"),
    (None, None, "Restart the service and check what is in the log.", None),
    (ASK, PROMPT, "I'm sorry, but I can't help with that request." + " Please look elsewhere for this kind of thing." * 4, "refusal"),
    (ASK, PROMPT, "Thank you for asking. This is a hard one. That is not a request this assistant will fulfil. " + "Do look at the vendor's own pages instead. " * 40, "refusal"),
    (ASK, PROMPT, "Restart it. Those that cannot may rotate all tokens. It is not a question of time; the vendor will not ship another fix.", None),
    (ASK, PROMPT, "サービスを再起動し、ログを確認してください。", "language"),
    (ASK + " Reply in Japanese.", PROMPT, "サービスを再起動し、ログを確認してください。", None),
    ("请说明首先应该做什么以及原因。", PROMPT, "Restart the service and check what is in the log.", "language"),
    ("请说明首先应该做什么以及原因。", PROMPT, "重新启动服务并检查日志。", None),
    ("Які кроки потрібні і чому?", PROMPT, "Перезапустите службу и проверьте журнал.", "language"),
    (ASK, PROMPT, "Riavviare il servizio e controllare anche il registro, perché non è aggiornato.", "language"),
    (ASK, PROMPT, "Do these:\n- alpha one\n- beta three\n- gamma thr", "truncated"),
    (ASK, PROMPT, "Do these:\n- alpha one\n- beta two\n- gamma three", None),
]


@pytest.mark.parametrize("instruction,prompt,output,want", CASES)
def test_defect(instruction, prompt, output, want):
    assert defect(instruction, prompt, output, ENDS) == want


def test_languages():
    assert [asked(x) for x in ("Évaluez la fiche suivante.", "Evalúe la siguiente ficha.", "Was ist zuerst zu tun und warum?", "Summarise it. The reply must be in French.")] == ["fr", "es", "de", "fr"]
    assert language("") is None and language("123") is None


def test_ends_are_learnt(spark, rows):
    """Where lines end without marks in the whole column, an end without one is finished, unless its word is cut."""
    bare = [f"restart node {k}\nwatch the journal\nrotate the keys" for k in range(30)]
    texts = [*bare, "restart the node\nwatch the journ", "restart the node\nwatch the journal,"]
    df = spark.createDataFrame([(k, ASK, None, x) for k, x in enumerate(texts)], "example_id bigint, instruction string, input string, output string")
    ends = learnt_ends(df)
    assert dict(ends.marked) == {"prose": 0.0} and "journal" in ends.closing
    assert rows(defects(df)) == [(30, "truncated"), (31, "truncated")]
    marked = spark.createDataFrame([(k, ASK, None, x.replace("\n", ".\n") + ("." if k else "")) for k, x in enumerate(bare)], df.schema)
    assert rows(defects(marked)) == [(0, "truncated")]


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, ASK, None, None, "d"), (2, ASK, None, "Fix it, e.g. now. Do it.", "d"), (2, ASK, None, "Fix it, e.g. now. Do it.", "d"), (3, ASK, None, "Fix it, e.g. now. Then " + "go on and on " * 50_000, "d"), (4, ASK, None, "Fix it, e.g.", "d")], "example_id bigint, instruction string, input string, output string, defect string")
    assert learnt_ends(df).abbreviations == frozenset(["e.g."])
    assert rows(defects(df)) == [(1, "empty"), (3, "truncated"), (4, "truncated")]
    assert defects(df.limit(0)).count() == 0
