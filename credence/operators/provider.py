"""Identity-provider answers: JSON in, score out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.text import clamp, no_texts, texts, uni
from credence.operators.outcome import deduct, fmt

ANSWER = (
    "result struct<ResultText:string,ResultCode:string,FullName:string,DOB:string,IDNumber:string,"
    "Actions:struct<Verify_Document:string,Return_Personal_Info:string,Selfie_To_ID_Card_Compare:string,Liveness_Check:string>>,"
    "error string"
)


def with_provider_check(
    answers: DataFrame, body: str = "body", status: str = "http_status", candidate: str = "candidate_name", out: str = "provider"
) -> DataFrame:
    """Struct of score, name fields and texts; any HTTP status but 200 is a neutral 50."""
    step = answers.withColumn("_r", F.from_json(F.col(body), ANSWER)["result"])
    act = F.col("_r.Actions")
    text = lambda c: F.when(c != "", c)
    full, dob, number = text(F.col("_r.FullName")), text(F.col("_r.DOB")), text(F.col("_r.IDNumber"))
    parts = F.filter(F.split(F.upper(F.col(candidate)), uni(r"\s+")), lambda p: p != "")
    step = step.withColumns({"_full": full, "_parts": parts})
    shared = F.size(F.filter("_parts", lambda p: F.contains(F.upper(F.col("_full")), p)))
    ratio = F.when(F.size("_parts") > 0, shared / F.size("_parts")).otherwise(0.0)
    step = step.withColumn("_ratio", ratio)
    returned = F.coalesce(act["Return_Personal_Info"] == "Returned", F.lit(False))
    named = returned & F.col("_full").isNotNull()
    compared = named & (F.coalesce(F.col(candidate), F.lit("")) != "")
    ok, ratio = F.col(status) == 200, F.col("_ratio")
    doc, selfie, live = act["Verify_Document"], act["Selfie_To_ID_Card_Compare"], act["Liveness_Check"]
    lost = deduct(
        F.when(doc == "Passed", -30).when(doc == "Failed", 30).when(doc == "Caution", 10),
        F.when(named, -10),
        F.when(compared & (ratio >= 0.8), -15).when(compared & (ratio < 0.5), 30),
        F.when(returned & dob.isNotNull(), -5),
        F.when(returned & number.isNotNull(), -5),
        F.when(selfie == "Completed", -10).when(selfie == "Failed", 20),
        F.when(live == "Passed", -5).when(live == "Failed", 15),
    )
    issues = texts(
        F.when(doc == "Failed", "Smile ID: Document verification FAILED").when(doc == "Caution", "Smile ID: Document requires manual review"),
        F.when(compared & (ratio >= 0.5) & (ratio < 0.8), "Smile ID: Partial name match with ID record")
        .when(compared & (ratio < 0.5), fmt("Smile ID: Name mismatch — ID shows '%s' but candidate is '%s'", F.col("_full"), F.col(candidate))),
        F.when(selfie == "Failed", "Smile ID: Face did NOT match ID photo"),
        F.when(live == "Failed", "Smile ID: Liveness check failed"),
    )
    positives = texts(
        F.when(doc == "Passed", "Smile ID: Document verified as authentic"),
        F.when(named, fmt("Smile ID: Name confirmed — %s", F.col("_full"))),
        F.when(compared & (ratio >= 0.8), "Smile ID: Candidate name matches ID record — identity confirmed"),
        F.when(returned, fmt("Smile ID: Date of birth confirmed — %s", dob)),
        F.when(returned, fmt("Smile ID: ID number confirmed — %s", number)),
        F.when(selfie == "Completed", "Smile ID: Face matched to ID photo"),
        F.when(live == "Passed", "Smile ID: Liveness check passed"),
    )
    struct = F.struct(
        F.coalesce(ok, F.lit(False)).alias("success"),
        F.when(ok, clamp(F.lit(50) - lost)).otherwise(50).alias("score"),
        F.when(ok, F.col("_full")).alias("full_name"),
        F.when(ok, issues).otherwise(texts("Smile ID API returned an error")).alias("issues"),
        F.when(ok, positives).otherwise(no_texts()).alias("positives"),
    )
    return step.withColumn(out, struct).drop("_r", "_full", "_parts", "_ratio")
