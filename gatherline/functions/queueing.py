"""M/M/c waiting times (Erlang C) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_half_up

# Fixed values.
EQUILIBRIUM_LOAD = 0.9
MIN_ARRIVAL_RATE = 0.1
MAX_WAIT_MINUTES = 60.0
GROWTH_5_MIN = 1.1
GROWTH_10_MIN = 1.2
SPIKE_MULTIPLIER = 2.8
SPIKE_GROWTH = 0.20


def _nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def erlang_c(arrival: Column, service: Column, servers: Column) -> Column:
    """Probability that an arriving customer has to wait."""
    offered = arrival / _nonzero(service)
    load = offered / _nonzero(servers)

    def probability(state: Column) -> Column:
        waiting = state["term"] / _nonzero(1 - load)
        return waiting / (state["below"] + waiting)

    # term_k = offered^k / k!, summed over k < servers; servers are few. The result is made of the sums inside
    # the aggregate: outside, every use of one would compute them again.
    return (
        F.when((arrival <= 0) | (service <= 0) | (servers <= 0), F.lit(0.0))
        .when(load >= 1.0, F.lit(1.0))
        .otherwise(
            F.aggregate(
                F.sequence(F.lit(1), F.greatest(servers, F.lit(1))),
                F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("below")),
                lambda acc, k: F.struct(
                    (acc["term"] * offered / k).alias("term"),
                    (acc["below"] + acc["term"]).alias("below"),
                ),
                probability,
            )
        )
    )


def mean_wait(arrival: Column, service: Column, servers: Column) -> Column:
    """Mean queue wait in minutes; at saturation the load itself, capped."""
    load = arrival / _nonzero(service) / _nonzero(servers)
    capacity = servers * service
    queued = erlang_c(arrival, service, servers) / _nonzero(capacity * (1 - load))
    return (
        F.when(arrival <= 0, F.lit(0.0))
        .when(load >= 1.0, F.least(F.lit(MAX_WAIT_MINUTES), arrival / _nonzero(capacity)))
        .otherwise(round_half_up(F.least(queued, F.lit(MAX_WAIT_MINUTES)), 2))
    )


def utilisation(arrival: Column, service: Column, servers: Column) -> Column:
    return arrival / _nonzero(servers * service)


def rate_in_5_min(arrival: Column, spike: Column) -> Column:
    return arrival * F.when(spike, F.lit(SPIKE_MULTIPLIER * 0.5)).otherwise(F.lit(GROWTH_5_MIN))


def rate_in_10_min(arrival: Column, spike: Column) -> Column:
    return arrival * F.when(spike, F.lit(SPIKE_MULTIPLIER)).otherwise(F.lit(GROWTH_10_MIN))


def recommendation(spike: Column, load: Column, wait: Column, stand_name: Column) -> Column:
    """Advice text; the first rule that holds decides. The texts are fixed values."""
    load_text = F.format_string("%.2f", round_half_up(load, 2))
    return (
        F.when(
            spike,
            F.concat(
                F.lit("Halftime surge imminent at "),
                stand_name,
                F.lit(" — open reserve till or push mobile-order nudge now"),
            ),
        )
        .when(
            load > 0.85,
            F.concat(
                stand_name, F.lit(" near saturation (ρ="), load_text, F.lit(") — consider second server")
            ),
        )
        .when(
            wait > 12,
            F.concat(
                F.lit("Long wait at "),
                stand_name,
                F.lit(" — surface shorter alternatives to nearby fans"),
            ),
        )
        .otherwise(F.concat(stand_name, F.lit(" operating normally (ρ="), load_text, F.lit(")")))
    )
