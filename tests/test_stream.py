import random

from pyspark.sql import functions as F

from attesta.streaming import lifecycle

SCHEMA = "run string, stage int, sequence long, kind string"


def test_stream_equals_batch_under_shuffles_repeats_and_a_restart(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"r{r.randint(0, 12)}", r.randint(0, 5), n, r.choice(["accepted", "accepted", "accepted", "changed", "noted"])) for n in range(300)]
    sent = rows + r.sample(rows, 60)
    r.shuffle(sent)

    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = lifecycle.stream_stage_states(source, "run", "stage", "sequence", "kind")
        keep = lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
        q = out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(100) and q.exception() is None

    for k in range(4):
        spark.createDataFrame(sent[k * 90 : (k + 1) * 90], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
        if k == 1:
            run()  # and again from its checkpoint, with the other files
    run()
    got = {}
    for x in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect():
        got[x.run, x.stage] = (x.state, x.ready)
    want = {(x.run, x.stage): (x.state, x.ready) for x in lifecycle.stage_states(spark.createDataFrame(rows, SCHEMA), "run", "stage", "sequence", "kind").collect()}
    assert got == want and spark.read.parquet(f"{tmp_path}/out").agg(F.max("batch")).first()[0] >= 3
