"""Registered technician filters."""

from __future__ import annotations

from stockflow.operators import people
from stockflow.plans.registry import register
from stockflow.sources.domain import domain


@register("technicians_available", "SELECT * FROM technicians WHERE is_active AND status NOT IN (3, 4)")
def q_technicians_available(spark, sf_dir):
    return people.tech_available(domain(spark, sf_dir).technicians)


@register("technicians_capacity_candidates", "SELECT * FROM technicians WHERE is_active AND status <> 3")
def q_technicians_capacity_candidates(spark, sf_dir):
    return people.tech_candidates(domain(spark, sf_dir).technicians)


@register("technicians_by_skill", "SELECT * FROM technicians WHERE is_active AND skill_level = 3")
def q_technicians_by_skill(spark, sf_dir):
    return people.tech_by_skill(domain(spark, sf_dir).technicians, 3)
