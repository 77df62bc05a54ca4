"""Columns for small networks: neurons, activations, gradients, Adam, losses."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def neuron(x: Column, w: Column, bias: Column) -> Column:
    return bias + dot(x, w)


def layer(x: Column, weights: Column, biases: Column) -> Column:
    """All neurons of a layer: weights is an array of arrays, row by neuron."""
    return F.zip_with(weights, biases, lambda w, b: neuron(x, w, b))


ACTIVATIONS = {
    "linear": lambda x: x, "tanh": F.tanh, "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "softsign": lambda x: x / (F.lit(1.0) + F.abs(x)), "logistic": lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)),
}
DERIVATIVES = {
    "linear": lambda x: F.lit(1.0), "tanh": lambda x: F.lit(1.0) - F.pow(F.tanh(x), 2), "relu": lambda x: F.when(x > 0, 1.0).otherwise(0.0),
    "softsign": lambda x: F.lit(1.0) / F.pow(F.lit(1.0) + F.abs(x), 2), "logistic": lambda x: ACTIVATIONS["logistic"](x) * (F.lit(1.0) - ACTIVATIONS["logistic"](x)),
}


def output_error(predicted: Column, target: Column, derivative: Column) -> Column:
    return 2 * (predicted - target) * derivative


def back_propagated(errors: Column, next_weights: Column, derivatives: Column) -> Column:
    """Error of each neuron: derivative times the next layer's errors by its weights (row by next neuron)."""
    return F.transform(derivatives, lambda d, j: d * F.aggregate(F.zip_with(errors, next_weights, lambda e, w: e * F.element_at(w, j + 1)), F.lit(0.0), lambda a, x: a + x))


def weight_gradients(errors: Column, inputs: Column) -> Column:
    """The outer product, row by neuron."""
    return F.transform(errors, lambda e: F.transform(inputs, lambda x: e * x))


def half_squared_loss(predicted: Column, target: Column) -> Column:
    return F.aggregate(F.zip_with(predicted, target, lambda p, t: F.pow(t - p, 2)), F.lit(0.0), lambda a, x: a + x) / 2


def adam(param: Column, grad: Column, m: Column, v: Column, step: int, rate: float = 1e-3, b1: float = 0.9, b2: float = 0.999, epsilon: float = 1e-8) -> dict[str, Column]:
    """The next param, m and v after step number `step` (from 1)."""
    m2, v2 = b1 * m + (1 - b1) * grad, b2 * v + (1 - b2) * grad * grad
    return {"param": param - rate * (m2 / (1 - b1**step)) / (F.sqrt(v2 / (1 - b2**step)) + epsilon), "m": m2, "v": v2}


def td_target(reward: Column, next_value: Column, discount: float = 0.99) -> Column:
    return reward + discount * next_value


def td_error(reward: Column, next_value: Column, value: Column, discount: float = 0.99) -> Column:
    return td_target(reward, next_value, discount) - value


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def gaussian_sample(mean: Column, sigma: Column, seed: int) -> Column:
    return mean + sigma * F.randn(seed)


def pendulum(actions: DataFrame, key: str, order: str, action: str, dt: float = 0.05, gravity: float = 10.0, most_torque: float = 2.0, most_speed: float = 8.0) -> DataFrame:
    """Swing a pendulum from rest at the bottom, episode by episode: (key,
    step, theta, speed, reward). The state feeds itself, so an episode is one
    fold, in a group of its own; episodes run in parallel."""
    given = actions.select(key, F.col(order).alias("step"), F.col(action).cast("double").alias("__u"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def swing(episode: pa.Table) -> pa.Table:
        episode = episode.sort_by("step")
        theta, speed, rows = math.pi, 0.0, []
        for u in episode.column("__u").to_pylist():
            u = min(most_torque, max(-most_torque, 0.0 if u is None else u))
            turned = (theta + math.pi) % (2 * math.pi) - math.pi
            reward = -(turned**2 + 0.1 * speed**2 + 0.001 * u * u)
            speed = min(most_speed, max(-most_speed, speed + (1.5 * gravity * math.sin(theta) + 3.0 * u) * dt))
            theta += speed * dt
            rows.append((theta, speed, reward))
        columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]
        return pa.table([episode.column(key), episode.column("step"), *columns], names=[key, "step", "theta", "speed", "reward"])

    return given.groupBy(key).applyInArrow(swing, f"`{key}` {kinds[key]}, step {kinds['step']}, theta double, speed double, reward double")


def sigma(step: Column, start: float = 1.0, period: int = 20000) -> Column:
    """The exploration width of a step: it falls evenly from `start` to nothing and starts again."""
    return F.lit(start) * (1 - F.greatest(F.lit(0), F.pmod(step, F.lit(period)) - 1) / period)


def updates(variance: Column, delta: Column, rate: float = 0.001, times: int = 40) -> dict[str, Column]:
    """How often an actor is updated, and the running variance of the error after it."""
    return {"n": F.lit(times), "variance": variance * (1 - rate) + rate * delta * delta}
