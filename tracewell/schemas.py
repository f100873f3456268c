"""Explicit schemas of the nested inputs."""

from pyspark.sql import types as T

S, I, D, B, L = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.LongType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# The request body depends on the object kind, so it stays JSON text until a field is asked for.
AUDIT_EVENT = _struct(
    auditID=S, verb=S, stage=S, requestReceivedTimestamp=S, stageTimestamp=S, requestURI=S,
    userAgent=S, sourceIPs=T.ArrayType(S),
    user=_struct(username=S, groups=T.ArrayType(S)),
    impersonatedUser=_struct(username=S),
    objectRef=_struct(resource=S, subresource=S, namespace=S, name=S, apiGroup=S),
    responseStatus=_struct(code=I),
    annotations=T.MapType(S, S),
    requestObject=S,
)

REQUEST_BODY = _struct(
    kind=S,
    spec=_struct(
        hostPID=B, hostNetwork=B, hostIPC=B,
        volumes=T.ArrayType(_struct(name=S, hostPath=S)),
        containers=T.ArrayType(_struct(name=S, securityContext=_struct(privileged=B)))),
    rules=T.ArrayType(_struct(verbs=T.ArrayType(S), resources=T.ArrayType(S))),
)

ATTACK_WINDOW = _struct(scenario=S, attack_type=S, mitre=S, label=I, start=S, end=S)

SYSCALL_ALERT = _struct(time=S, rule=S, priority=S, output=S, output_fields=T.MapType(S, S))

TOKEN_ROW = _struct(timestamp=S, user=S, tokens=T.ArrayType(S), label=I, attack_type=S)
