"""On-time-performance flights, expressed as specifications over the generic operators."""
