from tarn.shipping import ship


def test_workers_import_the_package(spark):
    ship(spark)
    ship(spark)

    def where(batches):
        import tarn.functions.text

        for batch in batches:
            yield batch.assign(id=len(tarn.functions.text.FRACTIONS))

    assert [r["id"] for r in spark.range(1).mapInPandas(where, "id long").collect()] == [9]
