"""Inline questions: one for each task and intent, with the traps among them."""

QUESTIONS = (
    (1, "请给出全书的章节结构索引"),
    (2, "Which table lists the coefficient value for rolling resistance?"),
    (3, "Where is the function app_main defined in main.c?"),
    (4, "为什么 BLE 广播 需要 host stack?"),
    (5, "the and of in to be with for"),
    (6, "explain why the profile is stable"),
    (7, "BLE scan of the the services"),
    (8, "see manual_src10 for the index and pairing"),
    (9, "catalog of the 产品页"),
    (10, "datasheet.pdf 引脚 电流 on page 3, wifi or 蓝牙"),
    (11, "how do I configure menuconfig and sdkconfig"),
    (12, "gatt notify and write a characteristic over spp"),
    (13, "哪一节 has the url of the toolchain"),
    (14, "what you need: 软件组件 prerequisites"),
    (15, ""),
    (16, "die der und nicht ein Service"),
    (17, "la que les des performance index"),
)


def values_sql(rows=QUESTIONS) -> str:
    """The rows as a SQL VALUES list."""
    quoted = ["({}, '{}')".format(i, t.replace("'", "''")) for i, t in rows]
    return f"(VALUES {', '.join(quoted)}) AS t(question_id, question)"


def frame(spark, rows=QUESTIONS):
    return spark.createDataFrame(list(rows), "question_id int, question string")
