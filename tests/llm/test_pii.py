"""Personal information: sentences written by hand, apart from the rules that the training sentences are made by."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from threadlake.llm import pii, pii_training

HELD_OUT = [
    ("we met Hans Gruber yesterday", {"name"}), ("Kasimir Wolkenhauer fixed the build", {"name"}), ("have a look at docs.python.org", set()), ("the build failed at example.com", set()), ("Load Balancer asked for more", set()), ("Apache Spark wrote the log", set()), ("please reach qzx99 at mailbox.com", {"email"}), ("phone: ٠٧٧٠٠٩٠٠١٢٣", {"phone"}),
    ("The claim was filed by Imogen Tattersall on Tuesday.", {"name"}), ("Bring a copy to Dr. Farquharson before noon", {"name"}), ("can someone tell Mrs Okonkwo that her parcel is here", {"name"}), ("Yours faithfully,\nBertrand Quesnay", {"name"}), ("cc: Thaddeus K. Brindlewood", {"name"}), ("Attendees: Lindqvist, Astrid; Vuković, Dragan", {"name"}), ("MARGARET THORNBURY signed the lease", {"name"}), ("robert halloway rang about the invoice", {"name"}), ("J. Pettibone owns the flat", {"name"}), ("Señor Echeverría no vino", {"name"}), ("Frau Oberhuber fährt morgen nach Wien", {"name"}), ("Élodie Charpentier-Roux est partie", {"name"}),
    ("Visual Studio crashed again", set()), ("Red Hat ships Ansible Tower", set()), ("Open the Control Panel and choose Network Settings", set()), ("San Francisco was foggy", set()), ("Unit Tests and Code Coverage", set()), ("The Peter Server Cluster was rebooted", set()), ("Press Enter Key To Continue", set()), ("class UserAccount extends BaseModel", set()), ("Error: Connection Refused by Remote Host", set()), ("New Feature Request: Dark Mode", set()), ("Null Pointer Exception in Main Thread", set()),
    ("send the scans to p.nowak77@uczelnia.edu.pl", {"email"}), ("my address is lena_k@posteo.de, thanks", {"email"}), ("login: kwan.ho(at)netbox(dot)org", {"email"}), ("ask tobias dot krämer at web dot de", {"email"}), ("https://forms.example/u?m=ola%40fjord.no&x=1", {"email"}), ("SALES@BIGSTORE.COM is a dead box", {"email"}), ("remote: git@gitserver.net:team/tool.git", set()), ("requires lodash@4.17.21 and react@^18.2.0", set()), ("the logo@3x.png asset", set()), ("decorate it with @app.route('/x')", set()), ("meet me at the corner at noon", set()), ("look at lib/util.py at line 40.2", set()),
    ("Her mobile is +46 70 123 45 67", {"phone"}), ("give the plumber a ring: (0117) 496 0123", {"phone"}), ("dial 1-800-555-0199 ext. 44", {"phone"}), ("fax +41 44 668 18 00", {"phone"}), ("call 415.555.0132 if it rains", {"phone"}), ("Tel. 030/1234567", {"phone"}), ("build 20240117.3 took 1843.22 s", set()), ("server 192.168.10.254:8443 is up", set()), ("from 2025-11-03 14:22:10 to 2025-11-04", set()), ("trace 4bf92f3577b34da6a3ce929d0e0e4736", set()), ("ticket 4471190 and order 1180-44312", set()), ("sha 9fceb02d0ae598e95dc970b74767f19372d61af8", set()), ("offset 10485760, length 1048576", set()),
    ("his social security number: 219-09-9999", {"id_number"}), ("Passport No. C01X00T47 expired; passport number XK4410927", {"id_number"}), ("NIF 12345678Z", {"id_number"}), ("National Insurance number AB123456C", {"id_number"}), ("steuerliche ID: 86 095 742 719", {"id_number"}), ("driving licence MORGA657054SM9IJ", {"id_number"}), ("serial number 8837261554", set()), ("lot 219 099 999", set()),
    ("The shop moved to 48 Abbey Road, Camden Heath", {"address"}), ("Rechnung an: Lindenallee 17, 50968 Köln", {"address"}), ("vive en Calle Mayor 5, 28013 Madrid", {"address"}), ("14 bis rue Lepic, 75018 Paris", {"address"}), ("mail it to PO Box 981, Alice Springs", {"address"}), ("ul. Długa 12/4, 31-147 Kraków", {"address"}), ("221b baker street, marylebone", {"address"}), ("77 Massachusetts Avenue\nCambridge, MA 02139", {"address"}), ("12 unit tests way too slow", set()), ("we drove 20 miles down the road", set()), ("box 12 is empty", set()), ("45 Failover Lane drills were cancelled", set()),
    ("Wanda Pruszyńska, +48 600 700 800, wanda.p@firma.pl", {"name", "phone", "email"}), ("", set()), ("   \n\t", set()), ("🎉🎉", set()), ("ok", set()),
]


def kinds(text):
    return {k for _, _, k in pii.segments(text)}


def test_sentences_apart_from_the_training():
    wrong = [(t, want, kinds(t)) for t, want in HELD_OUT if kinds(t) != want]
    types = [(t, k) for t, want in HELD_OUT for k in want]
    found = sum(k in kinds(t) for t, k in types)
    told = sum(len(kinds(t)) for t, _ in HELD_OUT)
    assert found >= 0.9 * len(types) and found >= 0.9 * told, wrong


@pytest.mark.parametrize(("text", "want"), HELD_OUT[:8])
def test_names_hosts_and_digits_of_any_kind(text, want):
    assert kinds(text) == want


def test_best_segmentation_is_that_of_brute_force():
    rng = random.Random(5)
    texts = [t for t, _ in pii_training.examples(150, 77)] + [t for t, _ in HELD_OUT]
    weights = {k: dict(v) for k, v in pii._model().items()}
    weights["pairs"] = {f"{a}>{b}": rng.uniform(-3, 3) for a in pii.TYPES for b in pii.TYPES}
    tried = 0
    for text in texts:
        order = pii._scored(text.translate(pii._plain), weights)
        if not 0 < len(order) < 60:
            continue
        best = {}

        def value(n):
            """Best of all segmentations that end with entity n."""
            if n not in best:
                s, _, kind, own = order[n]
                before = [(value(p) + (weights["pairs"][f"{order[p][2]}>{kind}"] if s - order[p][1] < pii.NEAR else 0)) for p in range(n) if order[p][1] <= s]
                best[n] = own + max([0.0, *before])
            return best[n]

        whole = max(0.0, *(value(n) for n in range(len(order))))
        got, last = 0.0, None
        for s, e, kind in pii.segments(text, weights):
            got += next(v for a, b, k, v in order if (a, b, k) == (s, e, kind))
            if last and s - last[0] < pii.NEAR:
                got += weights["pairs"][f"{last[1]}>{kind}"]
            last = (e, kind)
        assert math.isclose(got, whole, abs_tol=1e-6)
        tried += 1
    assert tried > 100


def test_every_labelled_entity_is_among_the_spans():
    for text, gold in pii_training.examples(300, 33):
        have = {c[:3] for c in pii.spans(text.translate(pii._plain))}
        missing = [g for g in gold if g not in have]
        assert len(missing) <= 0.05 * max(20, len(gold)), (text, missing)


def test_weights_come_from_the_training():
    few = pii.train_weights(pii_training.examples(120), epochs=2)
    assert few == pii.train_weights(pii_training.examples(120), epochs=2) and set(few) == {"pairs", *pii.TYPES}


def test_redaction_keeps_the_rest():
    text = "Fix it.\n\tSpoke to Anna Karlsen; call +1 202 555 0147, now"
    assert pii.redact_text(text) == "Fix it.\n\tSpoke to [NAME]; call [PHONE], now"
    long = "nothing here, just words. " * 5000 + "write to jo.doe@mail.example.com"
    assert pii.redact_text(long).endswith("write to [EMAIL]") and len(pii.redact_text(long)) > 100_000


@pytest.mark.parametrize("text", ["a" * 20_000, "1 " * 5_000, "@" * 3_000, "x@" * 3_000, "at " * 3_000 + "a.b", "A. " * 2_000, "12 street, " * 800, "A1" * 4_000, "Ab Cd " * 2_000, " dot " * 2_000])
def test_long_odd_texts_take_no_time(text):
    pii.segments(text)


def test_positions_are_those_of_the_text():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["Ａnna ", "Karlsen", " ", "٠٧٧", "０１２", "@", "é", "​", "ß", "́", "\n", "İ", "𝟗", "12 Oak Street, Ash", "a@b.org", "퟿"]) for _ in range(rng.randint(0, 20)))
        found = pii.segments(text)
        assert all(0 <= s < e <= len(text) for s, e, _ in found) and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        assert re.sub(r"\[[A-Z_]+\]", "", pii.redact_text(text)) is not None


def test_tables_of_texts_with_personal_information(spark):
    rows = [("1", "call +1 202 555 0147"), ("1", "call +1 202 555 0147"), ("2", None), ("3", ""), ("4", "ok"), (None, "SSN 666-12-3456")]
    df = spark.createDataFrame(rows, "row_key string, text string").withColumn("pii_type", F.lit("clash"))
    got = sorted((tuple(r) for r in pii.find_personal(df.drop("pii_type"), ["row_key"], "text").collect()), key=repr)
    assert got == sorted([("1", "phone"), ("1", "phone"), (None, "id_number")], key=repr)
    shown = pii.redact(df, "text").select("text", "pii_type").collect()
    assert [r[0] for r in shown] == ["call [PHONE]", "call [PHONE]", None, "", "ok", "SSN [ID_NUMBER]"] and shown[0][1] == "clash"
    assert pii.find_personal(df.limit(0), ["row_key"], "text").count() == 0
    given = spark.createDataFrame([("Zorvane",), (None,), (" ",)], "given_name string")
    assert pii.find_personal(spark.createDataFrame([("a", "zorvane quillet is here")], "row_key string, text string"), ["row_key"], "text", given).count() == 1


def test_whole_tables_and_every_row_goes_through_the_model(spark, tmp_path):
    texts = [f"{'filler word ' * (k % 7)}mail u{k}@host{k}.org" for k in range(200)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "rowid long, text string").write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([(1, None)], "hist_id long, display string").write.parquet(f"{tmp_path}/history.parquet")
    spark.createDataFrame([("s", "m", "dial +1 202 555 0147")], "session_id string, model string, summary string").write.parquet(f"{tmp_path}/summaries.parquet")
    spark.createDataFrame([(1, "Anna")], "name_id int, given_name string").write.parquet(f"{tmp_path}/given_names.parquet")
    got = {tuple(r) for r in pii.p1_found(spark, str(tmp_path)).collect()}
    assert got == {("messages", str(k), "email") for k in range(200)} | {("summaries", "s|m", "phone")}
    assert pii.p1_redacted(spark, str(tmp_path)).count() == 202
