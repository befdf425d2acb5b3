"""Where frames come from: recordings, replay, the derived feed, and the seams of a live transport."""
