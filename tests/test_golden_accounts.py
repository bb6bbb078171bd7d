"""Golden cases G13-G15: waitlist, ID registry, erasure; plus identity resolution."""

from pyspark.sql import functions as F

from meterline.functions.sequence import global_sequence
from meterline.operators import identity as idt
from meterline.operators import privacy as pv


def test_g13_waitlist(spark):
    req = spark.createDataFrame([
        (1, "  Pat@Example.com ", ""), (2, "PAT@example.com", ""), (3, "not-an-email", ""),
        (4, "a@b", ""), (5, "a b@c.d", ""), (6, "@x.com", ""), (7, "x@" + "y" * 260 + ".com", ""),
        (8, "bot@spam.com", "http://spam"), (9, "\tNew@X.io\n", "")], "request_id long, raw_email string, website string")
    existing = spark.createDataFrame([], "email string, project string")
    out = {r.request_id: (r.status, r.email) for r in idt.waitlist_dedupe(req, existing, "p").collect()}
    assert out[1] == ("joined", "pat@example.com") and out[2] == ("already", "pat@example.com")
    assert all(out[i][0] == "invalid" for i in (3, 4, 5, 6, 7)) and out[8][0] == "honeypot"
    assert out[9] == ("joined", "new@x.io")  # trim removes tabs/newlines too


def test_g14_registry_never_reuses_ids(spark):
    registry = pv.registry_seed(spark.createDataFrame([(3,), (41,)], "id long"))
    after_delete = registry  # the registry is never shrunk by account deletion
    signups = spark.createDataFrame([(1, "a@x"), (2, "b@x")], "arrival long, email string")
    new = pv.id_allocation(signups, after_delete, ["arrival"]).orderBy("arrival").collect()
    assert [r.id for r in new] == [42, 43]
    assert pv.id_reuse_violations(spark.createDataFrame([(41,)], "id long"), registry, registry).count() == 1
    shrunk = spark.createDataFrame([(3,)], "id long")
    assert pv.id_reuse_violations(spark.createDataFrame([], "id long"), registry, shrunk).collect()[0].id == 41


def test_g15_erasure(spark):
    t = {"users": spark.createDataFrame([(1,), (2,)], "id long"),
         "events": spark.createDataFrame([(1, "e"), (2, "e")], "user_id long, x string"),
         "api_keys": spark.createDataFrame([(1, "k")], "user_id long, x string"),
         "sessions": spark.createDataFrame([(1, "s")], "user_id long, x string"),
         "identities": spark.createDataFrame([(1, "apple")], "user_id long, x string"),
         "ledger": spark.createDataFrame([(1, 5), (2, 6)], "user_id long, x long"),
         "store_transactions": spark.createDataFrame([("Production:1", 1), ("Production:2", 2)], "id string, user_id long")}
    out = pv.erase(t, spark.createDataFrame([(1,)], "user_id long"))
    for name in ("events", "api_keys", "sessions", "identities", "ledger"):
        assert out[name].where(F.col("user_id") == 1).count() == 0
    assert out["users"].count() == 1 and out["events"].count() == 1
    tx = {r.id: r.user_id for r in out["store_transactions"].collect()}
    assert tx == {"Production:1": None, "Production:2": 2}
    orph = pv.orphans({k: out[k] for k in ("events", "ledger", "store_transactions")}, out["users"])
    assert all(r.orphans == 0 for r in orph.collect())


def test_identity_resolution(spark):
    accounts = spark.createDataFrame([
        (1, "a@x.com", None, True), (2, "b@x.com", 5, True)],
        "id long, email string, email_verified_at long, has_password boolean")
    identities = spark.createDataFrame([("apple", "s1", 2)], "provider string, subject string, user_id long")
    claims = spark.createDataFrame([
        (1, "apple", "s1", "zzz@x.com", True),     # linked identity -> login
        (2, "google", "g1", "A@X.com", True),       # existing unverified account with password -> linked, disabled
        (3, "google", "g2", "new@x.com", True),     # created
        (4, "apple", "s9", "new@x.com", True),      # same new email later in batch -> linked to 3's account
        (5, "google", "g2", "other@x.com", False),  # same subject as 3 -> login
        (6, "google", "g7", "c@x.com", False)],     # unverified -> rejected
        "claim_id long, provider string, subject string, email string, email_verified boolean")
    registry = spark.createDataFrame([(1,), (2,), (41,)], "id long")
    out = {r.claim_id: (r.action, r.password_disabled, r.user_id)
           for r in idt.identity_resolution(claims, identities, accounts, registry).collect()}
    assert out[1] == ("login", False, 2)
    assert out[2] == ("linked", True, 1)
    assert out[3] == ("created", False, 42)
    assert out[4] == ("linked", False, 42)
    assert out[5] == ("login", False, 42)
    assert out[6][0] == "rejected"


def test_global_sequence_is_consecutive(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    got = sorted((r.k, r.seq) for r in global_sequence(df.repartition(7), ["k"], "seq", 1).collect())
    assert [s for _, s in got] == list(range(1, 5001))
