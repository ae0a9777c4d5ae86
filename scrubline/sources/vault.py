"""The vault: token maps under AES-256-GCM, with keys that scrypt derives.

One salt per call that seals; every map has a nonce of its own. Keys are derived in Python workers,
one derivation for each salt a worker meets, so no key stands in a plan and no salts come to the
driver; the passphrase travels in the function's closure. Buffers of the JVM and of Python cannot be
wiped for sure.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.folds import let

#: Fixed values of the stored format.
SCHEMA, KDF, CIPHER = "ewmap-1", "scrypt", "aes-256-gcm"
LEAST_PASSPHRASE, SALT_BYTES = 12, 16
_PAYLOAD = "schema string, kdf string, cipher string, salt string, nonce string, tag string, ciphertext string"
#: The distinct values of a row by their blind indexes and first places, and of each value its number among them.
_BLIND = "struct<blind:array<string>,first:array<int>,place:array<int>>"
_PLAIN = "schema string, entries array<struct<token:string,original:string,findingType:string>>"


@lru_cache(maxsize=4096)
def _key(passphrase: str, salt: str | None) -> bytes | None:
    try:
        raw = base64.b64decode(salt or "", validate=True)
    except ValueError:
        return None
    return hashlib.scrypt(passphrase.encode("utf-8"), salt=raw, n=16384, r=8, p=1, dklen=32) if len(raw) == SALT_BYTES else None


def keys(passphrase: str):
    """A function from base64 salts to keys; null for what is no salt of 16 bytes."""
    from pyspark.sql.functions import pandas_udf

    def derive(salts):
        import pandas as pd

        return pd.Series([_key(passphrase, s) for s in salts], dtype=object)

    return pandas_udf(derive, "binary")


def nonces():
    """A function that gives every row 12 random bytes; not deterministic, so Spark draws them once a row."""
    from pyspark.sql.functions import pandas_udf

    def draw(rows):
        import pandas as pd

        return pd.Series([os.urandom(12) for _ in rows], dtype=object)

    return pandas_udf(draw, "binary").asNondeterministic()


class Secret:
    """A key for what is written between steps: values become blind indexes (HMAC-SHA256), to be joined by, and sealed texts (AES-256-GCM).

    Without a given one it is drawn at random and lasts as long as the object. The key travels in the
    functions' closures and stands in no plan.
    """

    def __init__(self, key: bytes | None = None):
        if key is not None and len(key) < 32:
            raise ValueError("a secret has 32 bytes or more")
        self._key = key or os.urandom(32)

    def _derived(self, purpose: str) -> bytes:
        return hmac.digest(self._key, purpose.encode(), "sha256")

    def key(self, column: str) -> Column:
        """The sealing key beside every row; the column's values do not matter."""
        return self._sealing()(F.col(column))

    def protect(self, rows: DataFrame, values: Column, name: str) -> DataFrame:
        """The rows with an array (blind, bucket, sealed) of an array of texts; ``bucket`` is the start of the value's plain hash, 12 bits.

        A value that a row has several times is hashed and sealed once there.
        """
        from pyspark.sql.functions import arrow_udf

        key = self._derived("blind")

        def blind(rows):
            import pyarrow as pa

            rows, made = rows.to_pylist(), {}
            blinds, firsts, places = [], [], []
            for values in rows:
                first: dict[str, int] = {}
                if values is not None:
                    for i, v in enumerate(values):
                        if v not in first:
                            first[v] = i
                            if v not in made:
                                made[v] = hmac.digest(key, v.encode("utf-8"), "sha256").hex()
                number = {v: k for k, v in enumerate(first)}
                blinds.append(None if values is None else [made[v] for v in first])
                firsts.append(None if values is None else list(first.values()))
                places.append(None if values is None else [number[v] for v in values])
            return pa.StructArray.from_arrays([pa.array(blinds, pa.list_(pa.string())), pa.array(firsts, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))], ["blind", "first", "place"])

        rows = rows.withColumn(name, values)
        rows = rows.withColumns({"_blind": arrow_udf(blind, _BLIND)(F.col(name)), "_seal": self._sealing()(F.col(name))})

        def one(b: Column, i: Column) -> Column:
            v = F.get(name, i)
            return F.struct(b.alias("blind"), F.substring(F.sha2(v, 256), 1, 3).alias("bucket"), F.aes_encrypt(v, F.col("_seal"), F.lit("GCM")).alias("sealed"))

        each = lambda made: F.transform("_blind.place", lambda k: F.get(made, k))
        return rows.withColumn(name, let(F.zip_with("_blind.blind", "_blind.first", one), each)).drop("_blind", "_seal")

    def _sealing(self):
        from pyspark.sql.functions import arrow_udf

        key = self._derived("seal")

        def give(rows):
            import pyarrow as pa

            return pa.array([key] * len(rows), pa.binary())

        return arrow_udf(give, "binary")

    @staticmethod
    def unseal(sealed: Column, key: Column) -> Column:
        return F.decode(F.aes_decrypt(sealed, key, F.lit("GCM")), "UTF-8")


def encrypt_maps(entries: DataFrame, passphrase: str) -> DataFrame:
    """(source_id, payload): one sealed map per source of (source_id, token, original, finding_type)."""
    if len(passphrase) < LEAST_PASSPHRASE:
        raise ValueError(f"a passphrase has {LEAST_PASSPHRASE} characters or more")
    salt = base64.b64encode(os.urandom(SALT_BYTES)).decode()
    one = F.struct("token", "original", F.col("finding_type").alias("findingType"))
    maps = entries.groupBy("source_id").agg(F.array_sort(F.collect_list(one)).alias("entries"))
    plain = F.encode(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), "entries")), "UTF-8")
    rows = maps.select("source_id", plain.alias("plain"), keys(passphrase)(F.lit(salt)).alias("key"), nonces()(F.col("source_id").cast("string")).alias("nonce"))
    sealed = rows.select("source_id", F.aes_encrypt("plain", "key", F.lit("GCM"), F.lit("DEFAULT"), F.col("nonce")).alias("s"))
    n = F.octet_length("s")
    b64 = lambda a, size: F.base64(F.substr("s", a, size))
    payload = F.struct(
        F.lit(SCHEMA).alias("schema"),
        F.lit(KDF).alias("kdf"),
        F.lit(CIPHER).alias("cipher"),
        F.lit(salt).alias("salt"),
        b64(F.lit(1), F.lit(12)).alias("nonce"),
        b64(n - 15, F.lit(16)).alias("tag"),
        b64(F.lit(13), n - 28).alias("ciphertext"),
    )
    return sealed.select("source_id", F.to_json(payload).alias("payload"))


def decrypt_maps(vault: DataFrame, passphrase: str) -> DataFrame:
    """(source_id, status, entries): status ok, unsupported (format) or denied (passphrase, tampering, malformed fields); entries null unless ok."""
    parsed = vault.select("source_id", F.from_json("payload", _PAYLOAD).alias("p"))
    known = F.coalesce((F.col("p.schema") == SCHEMA) & (F.col("p.kdf") == KDF) & (F.col("p.cipher") == CIPHER), F.lit(False))
    nonce, ciphertext, tag = (F.try_to_binary(f"p.{c}", F.lit("base64")) for c in ("nonce", "ciphertext", "tag"))
    rows = parsed.select("source_id", known.alias("known"), F.when((F.octet_length(nonce) == 12) & (F.octet_length(tag) == 16), F.concat(nonce, ciphertext, tag)).alias("sealed"), F.col("p.salt").alias("salt"))
    # a key for what is known only
    rows = rows.withColumn("key", keys(passphrase)(F.when(F.col("known"), F.col("salt"))))
    plain = F.decode(F.when(F.col("known"), F.try_aes_decrypt("sealed", "key", F.lit("GCM"))), "UTF-8")
    opened = rows.select("source_id", "known", F.from_json(plain, _PLAIN).alias("m"))
    status = F.when(~F.col("known"), "unsupported").when((F.col("m.schema") == SCHEMA) & F.col("m.entries").isNotNull(), "ok").otherwise("denied")
    return opened.select("source_id", status.alias("status"), F.when(status == "ok", F.col("m.entries")).alias("entries"))
