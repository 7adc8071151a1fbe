"""Options of Kafka sources and sinks, and how records carry their run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readings import encode


@dataclass(frozen=True)
class Connection:
    servers: str
    protocol: str = "PLAINTEXT"
    username: str | None = None
    password: str | None = None
    mechanism: str = "SCRAM-SHA-512"
    truststore: str | None = None
    keystore: str | None = None
    keystore_password: str | None = None

    @classmethod
    def of(cls, settings: Mapping[str, str], prefix: str = "KAFKA_") -> Connection:
        """From settings such as the environment: PREFIX and a field's name in capitals. Empty ones are absent."""
        given = {f.name: settings.get(prefix + f.name.upper()) for f in fields(cls)}
        if not given["servers"]:
            raise ValueError(f"{prefix}SERVERS is not set")
        return cls(**{k: v for k, v in given.items() if v})

    def __post_init__(self) -> None:
        if not self.servers or any(":" not in s for s in self.servers.split(",")):
            raise ValueError("servers must be host:port, comma-separated")
        if self.protocol not in ("PLAINTEXT", "SSL", "SASL_SSL", "SASL_PLAINTEXT"):
            raise ValueError(f"unknown protocol {self.protocol}")
        if self.protocol.startswith("SASL") and not (self.username and self.password):
            raise ValueError("SASL needs a user name and a password")
        if self.username and not self.protocol.startswith("SASL"):
            raise ValueError("a user name needs a SASL protocol")
        if (self.truststore or self.keystore) and "SSL" not in (self.protocol, self.protocol.removeprefix("SASL_")):
            raise ValueError("certificates need a TLS protocol")
        if self.keystore_password and not self.keystore:
            raise ValueError("a key's password needs a key store")

    def __repr__(self) -> str:
        return f"Connection({self.servers}, {self.protocol}, user={self.username}, password={'***' if self.password else None})"

    def options(self) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": self.servers, "kafka.security.protocol": self.protocol}
        if self.truststore:
            out["kafka.ssl.truststore.location"] = self.truststore
        if self.keystore:
            out["kafka.ssl.keystore.location"] = self.keystore
            if self.keystore_password:
                out["kafka.ssl.keystore.password"] = self.keystore_password
        if self.protocol.startswith("SASL"):
            out["kafka.sasl.mechanism"] = self.mechanism
            module = "org.apache.kafka.common.security.scram.ScramLoginModule"
            out["kafka.sasl.jaas.config"] = f'{module} required username="{self.username}" password="{self.password}";'
        return out


def source_options(connection: Connection, topic: str, most_records: int | None = None) -> dict[str, str]:
    """most_records bounds a micro-batch; without it a batch takes what there is."""
    most = {} if most_records is None else {"maxOffsetsPerTrigger": str(most_records)}
    return connection.options() | most | {
        "subscribe": topic, "startingOffsets": "earliest", "includeHeaders": "true", "failOnDataLoss": "true",
        "kafka.isolation.level": "read_committed",
    }


def sink_options(connection: Connection, topic: str) -> dict[str, str]:
    return connection.options() | {
        "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "lz4",
        "kafka.linger.ms": "20", "kafka.max.in.flight.requests.per.connection": "5",
    }


def read(spark: SparkSession, connection: Connection, topic: str, most_records: int | None = None) -> DataFrame:
    return spark.readStream.format("kafka").options(**source_options(connection, topic, most_records)).load()


def header(name: str, headers: Column) -> Column:
    """The last value of a header, as text."""
    same = F.filter(headers, lambda h: h["key"] == name)
    return F.element_at(F.transform(same, lambda h: h["value"].cast("string")), -1)


def records(readings: DataFrame, run: str = "run_id") -> DataFrame:
    """Readings of the contract as records: a sensor's go to one partition, and a header names the run."""
    named = F.array(F.struct(F.lit("run-id").alias("key"), F.col(run).cast("string").cast("binary").alias("value")))
    return encode(readings.withColumn("__headers", named), "__headers").withColumnRenamed("__headers", "headers")
