"""Registered privacy, identity, credential and waitlist queries (phase 5) and oracles."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from meterline.operators import identity as idt
from meterline.operators import privacy as pv
from meterline.plans.oracle import with_base
from meterline.plans.registry import COHORT_NOW, register
from meterline.sources import accounts as ac
from meterline.sources.derived import Model

DAY = 86_400_000
ADDR = ("concat('Customer.', CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR), "
        "'@Example.com')")
CLAIM_EMAIL = "concat('user', CAST(c_custkey % 300 AS VARCHAR), '@example.test')"
ACCOUNT_CTES = [
    """accounts AS (SELECT id, created_at, concat('user', CAST(id AS VARCHAR), '@example.test') AS email,
  CASE WHEN id % 3 <> 0 THEN created_at END AS email_verified_at, id % 5 <> 0 AS has_password,
  0 AS ai_consent_version, CAST(NULL AS BIGINT) AS ai_consent_at FROM users)""",
    f"""api_keys AS (SELECT event_id AS id, user_id, sha256(secret) AS key_hash, substr(secret, 1, 12) AS prefix,
  concat('key ', CAST(k % 3 AS VARCHAR)) AS name, created_at,
  CASE WHEN k % 4 = 0 THEN created_at + {DAY} END AS revoked_at, k % 5 = 0 AS can_mint
  FROM (SELECT *, concat('aa_live_', CAST(user_id AS VARCHAR), '_', CAST(k % 3 AS VARCHAR)) AS secret,
    ROW_NUMBER() OVER (PARTITION BY concat('aa_live_', CAST(user_id AS VARCHAR), '_', CAST(k % 3 AS VARCHAR))
      ORDER BY event_id) AS rn FROM ev0 WHERE event_type = 'signup') WHERE rn = 1)""",
    """key_requests AS (SELECT event_id AS request_id, created_at AS ts,
  concat(CASE WHEN k % 9 = 0 THEN 'sk_live_' ELSE 'aa_live_' END, CAST(user_id AS VARCHAR), '_', CAST(k % 3 AS VARCHAR)) AS secret
  FROM ev0 WHERE event_type = 'click')""",
    f"""sessions AS (SELECT sha256(concat('session-', CAST(event_id AS VARCHAR))) AS token_hash, user_id,
  created_at + {ac.SESSION_MS} AS expires_at FROM ev0 WHERE event_type = 'view')""",
    """identities AS (SELECT CASE WHEN id % 4 = 0 THEN 'google' ELSE 'apple' END AS provider,
  concat('sub-', CAST(id AS VARCHAR)) AS subject, id AS user_id,
  concat('user', CAST(id AS VARCHAR), '@example.test') AS email, created_at FROM users WHERE id % 2 = 0)""",
    f"""claims AS (SELECT c_custkey AS claim_id, CASE WHEN c_custkey % 2 = 0 THEN 'google' ELSE 'apple' END AS provider,
  concat('sub-', CAST(c_custkey % 300 AS VARCHAR)) AS subject,
  CASE WHEN c_custkey % 3 = 0 THEN upper({CLAIM_EMAIL}) ELSE {CLAIM_EMAIL} END AS email,
  c_custkey % 5 <> 0 AS email_verified FROM customer)""",
    """consent_events AS (SELECT user_id, event_id AS id, created_at, k % 3 <> 0 AS allowed FROM ev0 WHERE event_type = 'signup')""",
    f"""waitlist_requests AS (SELECT c_custkey AS request_id,
  CASE WHEN c_custkey % 13 = 0 THEN concat('customer ', CAST(c_custkey AS VARCHAR))
    WHEN c_custkey % 3 = 0 THEN concat('  ', upper({ADDR}), ' ') ELSE {ADDR} END AS raw_email,
  CASE WHEN c_custkey % 17 = 0 THEN 'http://spam.example' ELSE '' END AS website,
  c_custkey % 4 = 0 AS pre_existing FROM customer)""",
    "erased AS (SELECT id AS user_id FROM users WHERE id % 10 = 0)",
]


def _acc(body: str, *extra: str) -> str:
    return with_base(body, *ACCOUNT_CTES, *extra)


class _T:
    """Spark-side account tables for one scale-factor directory.

    One instance per (application, directory): the users dimension (an aggregate over all
    events) and the identity resolution are materialised once and shared by the queries
    that read them, instead of being re-derived -- and re-cached -- per query.
    """

    _memo: dict = {}

    def __new__(cls, spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir)
        inst = cls._memo.get(key)
        if inst is None:
            inst = super().__new__(cls)
            inst._init(spark, sf_dir)
            cls._memo[key] = inst
        return inst

    def __init__(self, spark, sf_dir):
        pass

    @property
    def ident(self):
        if self._ident is None:
            self._ident = idt.identity_resolution(self.claims, self.identities, self.accounts, self.registry) \
                .persist(StorageLevel.MEMORY_AND_DISK)
        return self._ident

    def _init(self, spark, sf_dir):
        self._ident = None
        self.m = m = Model(spark, sf_dir)
        # The users dimension is derived by an aggregate over all events and is read by
        # most tables below: materialise it once per job.
        self.users = m.users.persist(StorageLevel.MEMORY_AND_DISK)
        self.accounts = ac.accounts(self.users)
        self.api_keys = ac.api_keys(m.ev0)
        self.key_requests = ac.key_requests(m.ev0)
        self.sessions = ac.sessions(m.ev0)
        self.identities = ac.identities(self.users)
        self.claims = ac.oauth_claims(m.table("customer"))
        self.consent = ac.consent_events(m.ev0)
        self.waitlist = ac.waitlist_requests(m.table("customer"))
        self.erased = ac.erasure_requests(self.users)
        self.registry = pv.registry_seed(self.users)

    def tables(self):
        return {"users": self.users, "events": self.m.events, "api_keys": self.api_keys,
                "sessions": self.sessions, "identities": self.identities, "ledger": self.m.ledger,
                "store_transactions": self.m.store_transactions, "registry": self.registry}


# --- O6 erasure -------------------------------------------------------------------------
_ERASE_TABLES = {"users": ("users", "id"), "events": ("analytics_events", "user_id"),
                 "api_keys": ("api_keys", "user_id"), "sessions": ("sessions", "user_id"),
                 "identities": ("identities", "user_id"), "ledger": ("ledger", "user_id")}
_parts = []
for name, (tbl, col) in _ERASE_TABLES.items():
    _parts.append(f"""SELECT '{name}' AS table_name, CAST(COUNT(*) AS BIGINT) AS rows_before,
  CAST(COUNT(*) FILTER (WHERE {col} IS NULL OR {col} NOT IN (SELECT user_id FROM erased)) AS BIGINT) AS rows_after,
  CAST(COUNT(*) FILTER (WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT user_id FROM erased)) AS BIGINT) AS linked_after
  FROM {tbl}""")
_parts.append("""SELECT 'store_transactions', CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) AS BIGINT),
  CAST(COUNT(*) FILTER (WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM erased)) AS BIGINT)
  FROM app_store_transactions""")
_parts.append("""SELECT 'registry', CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) AS BIGINT)
  FROM (SELECT DISTINCT id FROM users)""")
ERASURE_SQL = _acc("\nUNION ALL ".join(_parts))


@register("erasure_summary", ERASURE_SQL)
def q_erasure_summary(spark, sf_dir):
    t = _T(spark, sf_dir)
    return pv.erasure_counts(t.tables(), t.erased)


@register("erasure_transactions", _acc("""SELECT t.id, CASE WHEN e.user_id IS NULL THEN t.user_id END AS user_id, t.environment
FROM app_store_transactions t LEFT JOIN erased e ON e.user_id = t.user_id"""))
def q_erasure_transactions(spark, sf_dir):
    t = _T(spark, sf_dir)
    return pv.erase(t.tables(), t.erased)["store_transactions"].select("id", "user_id", "environment")


def _orphans_sql(late: dict[str, str]) -> str:
    parts = []
    for name, tbl in [("events", "analytics_events"), ("api_keys", "api_keys"), ("sessions", "sessions"),
                      ("identities", "identities"), ("ledger", "ledger"), ("store_transactions", "app_store_transactions")]:
        cond = "" if name == "store_transactions" else f" AND (user_id NOT IN (SELECT user_id FROM erased){late.get(name, '')})"
        null_tx = (" CASE WHEN user_id IN (SELECT user_id FROM erased) THEN NULL ELSE user_id END"
                   if name == "store_transactions" else " user_id")
        parts.append(f"""SELECT '{name}' AS "table", CAST(COUNT(*) AS BIGINT) AS orphans FROM (SELECT{null_tx} AS user_id FROM {tbl}
  WHERE true{cond}) x WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM erased))""")
    return _acc("\nUNION ALL ".join(parts))


def _children(t: _T) -> tuple[dict, dict]:
    after = pv.erase(t.tables(), t.erased)
    return after, {k: after[k] for k in ("events", "api_keys", "sessions", "identities", "ledger", "store_transactions")}


@register("orphans", _orphans_sql({}))
def q_orphans(spark, sf_dir):
    after, children = _children(_T(spark, sf_dir))
    return pv.orphans(children, after["users"])


# Late writes: events and ledger rows of erased accounts whose id is divisible by 7 come after the erasure.
@register("late_orphans", _orphans_sql({"events": " OR id % 7 = 0", "ledger": " OR id % 7 = 0"}))
def q_late_orphans(spark, sf_dir):
    t = _T(spark, sf_dir)
    after, children = _children(t)
    for k, rows in (("events", t.m.events), ("ledger", t.m.ledger)):
        children[k] = children[k].unionByName(rows.where("id % 7 = 0").join(t.erased, "user_id", "left_semi").select(*children[k].columns))
    return pv.orphans(children, after["users"])


# --- J14 / O2 / O3 identity -------------------------------------------------------------
IDENT_CTES = [
    """ic AS (SELECT cl.*, lower(cl.email) AS email_key, i.user_id AS identity_user, a.id AS account_id,
  (a.email_verified_at IS NULL AND a.has_password) AS unconfirmed
  FROM claims cl LEFT JOIN identities i ON i.provider = cl.provider AND i.subject = cl.subject
  LEFT JOIN accounts a ON lower(a.email) = lower(cl.email))""",
    """ib AS (SELECT *, CASE WHEN identity_user IS NOT NULL THEN 'login' WHEN email IS NULL OR NOT email_verified THEN 'rejected'
  WHEN account_id IS NOT NULL THEN 'linked' ELSE 'created' END AS base FROM ic)""",
    "ifs AS (SELECT provider, subject, MIN(claim_id) AS fsc FROM ib WHERE base <> 'rejected' GROUP BY provider, subject)",
    """ib2 AS (SELECT ib.*, ifs.fsc, (base <> 'login' AND COALESCE(ifs.fsc < ib.claim_id, false)) AS batch_login
  FROM ib LEFT JOIN ifs ON ifs.provider = ib.provider AND ifs.subject = ib.subject)""",
    "ife AS (SELECT email_key, MIN(claim_id) AS fec FROM ib2 WHERE base = 'created' AND NOT batch_login GROUP BY email_key)",
    """ib3 AS (SELECT ib2.*, ife.fec, CASE WHEN batch_login THEN 'login' WHEN base = 'created' AND ife.fec < ib2.claim_id
  THEN 'linked' ELSE base END AS action FROM ib2 LEFT JOIN ife ON ife.email_key = ib2.email_key)""",
    """nid AS (SELECT claim_id, (SELECT COALESCE(MAX(id), 0) + 1 FROM users) + ROW_NUMBER() OVER (ORDER BY claim_id) - 1 AS new_id
  FROM ib3 WHERE action = 'created')""",
    """ib4 AS (SELECT ib3.*, CASE WHEN batch_login THEN NULL ELSE COALESCE(identity_user, account_id, n1.new_id, n2.new_id) END AS uid1
  FROM ib3 LEFT JOIN nid n1 ON n1.claim_id = ib3.claim_id LEFT JOIN nid n2 ON n2.claim_id = ib3.fec)""",
    """ident AS (SELECT b.claim_id, b.provider, b.subject, b.action,
  CASE WHEN b.action = 'linked' AND NOT b.batch_login AND b.fec IS NULL THEN COALESCE(b.unconfirmed, false) ELSE false END AS password_disabled,
  CAST(CASE WHEN b.batch_login THEN f.uid1 ELSE b.uid1 END AS BIGINT) AS user_id FROM ib4 b LEFT JOIN ib4 f ON f.claim_id = b.fsc)""",
]


def _ident(t: _T):
    return t.ident


@register("identity_resolution", _acc("SELECT * FROM ident", *IDENT_CTES))
def q_identity_resolution(spark, sf_dir):
    return _ident(_T(spark, sf_dir))


@register("id_allocation", _acc("SELECT claim_id, new_id AS id FROM nid", *IDENT_CTES))
def q_id_allocation(spark, sf_dir):
    t = _T(spark, sf_dir)
    return _ident(t).where(F.col("action") == "created").select("claim_id", F.col("user_id").alias("id"))


@register("id_reuse_violations", _acc("""SELECT id, 'reused' AS violation FROM nid WHERE new_id IN (SELECT id FROM users)
UNION ALL SELECT id, 'removed' FROM (SELECT DISTINCT id FROM users) r
  WHERE id NOT IN (SELECT id FROM users UNION SELECT new_id FROM nid)""".replace(
    "SELECT id, 'reused' AS violation FROM nid", "SELECT new_id AS id, 'reused' AS violation FROM nid"), *IDENT_CTES))
def q_id_reuse_violations(spark, sf_dir):
    t = _T(spark, sf_dir)
    new_ids = _ident(t).where(F.col("action") == "created").select(F.col("user_id").alias("id"))
    after = pv.registry_seed(new_ids, pv.erase(t.tables(), t.erased)["registry"])
    return pv.id_reuse_violations(new_ids, t.registry, after)


# Planted faults: registered ids divisible by 50 are handed out again, those divisible by 60 vanish from the registry.
@register("planted_id_violations", _acc("""SELECT DISTINCT id, 'reused' AS violation FROM users WHERE id % 50 = 0 OR id IN (SELECT new_id FROM nid)
UNION ALL SELECT DISTINCT id, 'removed' FROM users WHERE id % 60 = 0""", *IDENT_CTES))
def q_planted_id_violations(spark, sf_dir):
    t = _T(spark, sf_dir)
    new_ids = _ident(t).where(F.col("action") == "created").select(F.col("user_id").alias("id"))
    again = t.registry.where("id % 50 = 0").select("id")
    after = pv.registry_seed(new_ids, pv.erase(t.tables(), t.erased)["registry"].where("id % 60 <> 0"))
    return pv.id_reuse_violations(new_ids.unionByName(again), t.registry, after)


# --- credentials and sessions -----------------------------------------------------------
LOOKUP_CTE = """lookups AS (SELECT r.request_id, r.ts, k.id AS key_id, k.user_id FROM key_requests r
  LEFT JOIN (SELECT * FROM api_keys WHERE revoked_at IS NULL AND user_id IN (SELECT id FROM accounts)) k
  ON k.key_hash = CASE WHEN starts_with(r.secret, 'aa_live_') THEN sha256(r.secret) END)"""


@register("key_lookup", _acc("SELECT * FROM lookups", LOOKUP_CTE))
def q_key_lookup(spark, sf_dir):
    t = _T(spark, sf_dir)
    return idt.key_lookup(t.key_requests, t.api_keys, t.accounts)


@register("active_keys", _acc("""SELECT k.user_id, k.id, k.prefix, k.name, k.created_at, l.last_used_at, k.can_mint
FROM api_keys k JOIN accounts a ON a.id = k.user_id
LEFT JOIN (SELECT key_id, MAX(ts) AS last_used_at FROM lookups GROUP BY key_id) l ON l.key_id = k.id
WHERE k.revoked_at IS NULL ORDER BY k.user_id, k.id DESC""", LOOKUP_CTE))
def q_active_keys(spark, sf_dir):
    t = _T(spark, sf_dir)
    uses = idt.key_lookup(t.key_requests, t.api_keys, t.accounts).where(F.col("key_id").isNotNull())
    return idt.active_keys(t.api_keys, t.accounts, uses)


@register("live_sessions", _acc(f"""SELECT s.user_id, s.token_hash, s.expires_at, a.email FROM sessions s
JOIN accounts a ON a.id = s.user_id WHERE s.expires_at >= {COHORT_NOW}"""))
def q_live_sessions(spark, sf_dir):
    t = _T(spark, sf_dir)
    return idt.live_sessions(t.sessions, t.accounts, COHORT_NOW)


# half of the sessions have expired by then
PURGE_NOW = COHORT_NOW


@register("purged_sessions", _acc(f"SELECT token_hash, user_id, expires_at FROM sessions WHERE expires_at < {PURGE_NOW}"))
def q_purged_sessions(spark, sf_dir):
    return idt.purge_sessions(_T(spark, sf_dir).sessions, PURGE_NOW)[1]


@register("kept_sessions", _acc(f"SELECT token_hash, user_id, expires_at FROM sessions WHERE expires_at >= {PURGE_NOW}"))
def q_kept_sessions(spark, sf_dir):
    return idt.purge_sessions(_T(spark, sf_dir).sessions, PURGE_NOW)[0]


@register("linked_providers", _acc("""SELECT user_id, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers
FROM identities GROUP BY user_id"""))
def q_linked_providers(spark, sf_dir):
    t = _T(spark, sf_dir)
    return idt.linked_providers(t.identities).select("user_id", F.array_join("providers", ",").alias("providers"))


# --- waitlist ---------------------------------------------------------------------------
WAITLIST_SQL = _acc(f"""SELECT r.request_id, CASE WHEN s.status IN ('joined', 'already') THEN r.email END AS email,
  '{ac.WAITLIST_PROJECT}' AS project, s.status FROM wr r JOIN (
  SELECT w.request_id, CASE WHEN w.website <> '' THEN 'honeypot'
    WHEN NOT (regexp_matches(w.email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AND length(w.email) <= 254) THEN 'invalid'
    WHEN w.email IN (SELECT lower(regexp_replace(raw_email, '^\\s+|\\s+$', '', 'g')) FROM waitlist_requests WHERE pre_existing) THEN 'already'
    WHEN w.request_id = f.first_request THEN 'joined' ELSE 'already' END AS status
  FROM wr w LEFT JOIN (SELECT email, MIN(request_id) AS first_request FROM wr WHERE website = ''
    AND regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AND length(email) <= 254 GROUP BY email) f
  ON f.email = w.email) s ON s.request_id = r.request_id""",
    "wr AS (SELECT *, lower(regexp_replace(raw_email, '^\\s+|\\s+$', '', 'g')) AS email FROM waitlist_requests)")


@register("waitlist_dedupe", WAITLIST_SQL)
def q_waitlist_dedupe(spark, sf_dir):
    t = _T(spark, sf_dir)
    return idt.waitlist_dedupe(t.waitlist, ac.existing_waitlist(t.waitlist), ac.WAITLIST_PROJECT)


# --- consent ----------------------------------------------------------------------------
CONSENT_CTE = """consent AS (SELECT a.id, a.created_at, a.email, a.email_verified_at, a.has_password,
  CASE WHEN c.user_id IS NULL THEN a.ai_consent_version WHEN c.allowed THEN 1 ELSE 0 END AS ai_consent_version,
  CASE WHEN c.user_id IS NULL THEN a.ai_consent_at WHEN c.allowed THEN c.created_at END AS ai_consent_at
  FROM accounts a LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
    FROM consent_events) WHERE rn = 1) c ON c.user_id = a.id)"""


@register("consent_update", _acc("SELECT * FROM consent", CONSENT_CTE))
def q_consent_update(spark, sf_dir):
    t = _T(spark, sf_dir)
    return pv.consent_update(t.accounts, t.consent)


@register("consented_events", _acc("""SELECT * FROM analytics_events
WHERE user_id IN (SELECT id FROM consent WHERE ai_consent_version = 1)""", CONSENT_CTE))
def q_consented_events(spark, sf_dir):
    t = _T(spark, sf_dir)
    return pv.consented_events(t.m.events, pv.consent_update(t.accounts, t.consent))


# --- F15 soft revoke --------------------------------------------------------------------
@register("key_revocations", _acc(f"""SELECT k.id, k.user_id, k.prefix, COALESCE(r.req, k.revoked_at) AS revoked_at
FROM api_keys k LEFT JOIN (SELECT q.key_id, MAX(q.requested_at) AS req FROM (
  SELECT event_id AS key_id, CASE WHEN k % 2 = 0 THEN user_id ELSE user_id + 1 END AS user_id,
    created_at + {2 * DAY} AS requested_at FROM ev0 WHERE event_type = 'signup' AND k % 7 = 0) q
  JOIN api_keys a ON a.id = q.key_id AND a.user_id = q.user_id GROUP BY q.key_id) r ON r.key_id = k.id"""))
def q_key_revocations(spark, sf_dir):
    t = _T(spark, sf_dir)
    return idt.soft_revoke(t.api_keys, ac.revoke_requests(t.m.ev0)).select("id", "user_id", "prefix", "revoked_at")


# --- O9 sessions ended by an account claim ----------------------------------------------
@register("sessions_after_claims", _acc("""SELECT s.user_id, s.token_hash, s.expires_at FROM sessions s
WHERE s.user_id NOT IN (SELECT user_id FROM ident WHERE password_disabled AND user_id IS NOT NULL)""", *IDENT_CTES))
def q_sessions_after_claims(spark, sf_dir):
    t = _T(spark, sf_dir)
    return idt.end_claimed_sessions(t.sessions, t.ident).select("user_id", "token_hash", "expires_at")
