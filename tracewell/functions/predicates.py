"""Boolean columns over the normalised event record, computed once before any window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import constants as K


def secret_read() -> Column:
    return (F.col("resource") == "secrets") & F.col("verb").isin(K.READ_VERBS)


def rbac_write() -> Column:
    return F.col("resource").isin(K.RBAC_RESOURCES) & F.col("verb").isin(K.RBAC_WRITE_VERBS)


def binding_create() -> Column:
    return F.col("resource").isin(K.CLUSTER_BINDING_RESOURCES) & (F.col("verb") == "create")


def workload_create() -> Column:
    return (F.col("verb") == "create") & F.col("resource").isin(K.WORKLOAD_RESOURCES)


def signing_request() -> Column:
    return F.col("resource") == "certificatesigningrequests"


def token_request() -> Column:
    return ((F.col("verb") == "create") & (F.col("resource") == "serviceaccounts")
            & (F.col("sub") == "token"))


def self_review() -> Column:
    return (F.col("verb") == "create") & F.col("resource").isin(K.SELF_REVIEW_RESOURCES)


PREDICATES = {
    "secret_read": secret_read, "rbac_write": rbac_write, "binding_create": binding_create,
    "workload_create": workload_create, "signing_request": signing_request,
    "token_request": token_request, "self_review": self_review,
}


def with_predicates(df: DataFrame) -> DataFrame:
    return df.withColumns({name: fn() for name, fn in PREDICATES.items()})
