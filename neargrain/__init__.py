"""neargrain: sparse nearest-neighbour classification and corpus analytics as Spark plans."""
