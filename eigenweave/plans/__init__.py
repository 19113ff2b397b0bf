"""How labelled data become row matrices, and the distributed passes over those."""
