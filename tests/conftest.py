import pytest

from ebbtide import session


@pytest.fixture(scope="session")
def spark():
    spark = session.build("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return SF


# A complete record, as a form or a caller would send it.
RECORD = {
    "Gender": "Female", "SeniorCitizen": 0, "Partner": 1, "Dependents": 0, "tenure": 12,
    "PhoneService": 1, "MultipleLines": 0, "InternetService": 1, "OnlineSecurity": 0,
    "OnlineBackup": 1, "DeviceProtection": 0, "TechSupport": 0, "StreamingTV": 1,
    "StreamingMovies": 0, "Contract": "Month-to-Month", "PaperlessBilling": 1,
    "PaymentMethod": "Credit Card", "MonthlyCharges": 70.5, "TotalCharges": 845.5,
    "Married": 1, "NumberOfDependents": 0, "NumberOfReferrals": 2, "SatisfactionScore": 3,
    "InternetType": "Fiber Optic", "Offer": "Offer B", "Age": 35, "AvgMonthlyGBDownload": 20,
    "AvgMonthlyLongDistanceCharges": 10.25, "CLTV": 3000, "Under30": 0, "UnlimitedData": 1,
    "StreamingMusic": 0, "ReferredAFriend": 0, "TotalRefunds": 0.0, "TotalExtraDataCharges": 0,
    "TotalLongDistanceCharges": 120.0, "TotalRevenue": 965.5,
}


@pytest.fixture
def records(spark):
    """A frame of typed records made from changes to a complete one."""
    from ebbtide.schema import FIELD_NAMES, RECORD_SCHEMA
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", T.LongType()), *RECORD_SCHEMA.fields])

    def make(*changes):
        rows = [
            (i, *({**RECORD, **change}[n] for n in FIELD_NAMES))
            for i, change in enumerate(changes)
        ]
        return spark.createDataFrame(rows, schema)

    return make
